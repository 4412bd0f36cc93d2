"""``python -m revline review PATH`` — the review command over a folder of source files.

Options follow the reference's command: --scope, --files, --severity (applied as the threshold),
--format (markdown, json, html, all) and --output. Prints the summary (totals, counts per severity,
top five) and writes one report folder per repository.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="revline")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("review", help="review a folder of source files")
    r.add_argument("path")
    r.add_argument("--repo-id", default=None)
    r.add_argument("--scope", default="full", choices=["full", "files", "security_only", "performance_only"])
    r.add_argument("--files", default=None, help="comma-separated paths (scope files)")
    r.add_argument("--severity", default="medium", choices=["critical", "high", "medium", "low", "info"])
    r.add_argument("--format", default="markdown", choices=["markdown", "json", "html", "all"])
    r.add_argument("--output", default="./reports")
    r.add_argument("--master", default="local[*]")
    args = ap.parse_args(argv)

    from revline.operators import scope as B
    from revline.plans.review import review
    from revline.session import get_session
    from revline.sources.files import scan_corpus
    from revline.sources.sinks import write_reports

    spark = get_session(master=args.master)
    files = scan_corpus(spark, args.path, repo_id=args.repo_id or args.path)
    targets = args.files.split(",") if args.files else None
    res = review(files, scope=args.scope, target_files=targets)
    findings = res.findings.filter(B.meets_threshold("severity", F.lit(args.severity)))

    from revline.operators import synthesis as S
    from revline.plans import reports as RP
    counts = {row["severity"]: row["n"] for row in S.severity_counts(findings).collect()}
    total = sum(counts.values())
    print(f"Total Issues: {total}")
    for sev in ["critical", "high", "medium", "low", "info"]:
        print(f"{sev.title()}: {counts.get(sev, 0)}")
    for row in S.top_k(findings, 5).orderBy("repo_id", "pos").collect():
        print(f"{row['headline']}\n   {row['location']}")
    written = write_reports(RP.markdown_lines(findings, res.progress.select("repo_id")),
                            RP.json_lines(findings, res.progress.select("repo_id")), args.output, args.format)
    print(json.dumps({"written": written, "output": args.output}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
