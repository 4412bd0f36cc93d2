"""Parse each file once into structural facts.

Parsing is the only per-row Python step of a review. It runs as ``mapInPandas`` over Arrow
batches; everything before it (scope filters, newline normalisation, line scans) and after it
(detectors, synthesis) is native. The parser output drops ``content`` so the wide column never
travels past this step.
"""

from __future__ import annotations

import ast
import gc
from collections import OrderedDict
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.sources.tables import few_splits

FUNCTION_T = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("is_async", T.BooleanType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("owner", T.IntegerType()),  # place of the class whose body holds it, null outside class bodies
])
CLASS_T = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
])
IMPORT_T = T.StructType([  # one for each imported name
    T.StructField("module", T.StringType()),
    T.StructField("name", T.StringType()),   # null where the module itself is imported
    T.StructField("alias", T.StringType()),
    T.StructField("level", T.IntegerType()),  # leading dots
    T.StructField("nth", T.IntegerType()),    # place of the name in its statement
    T.StructField("line", T.IntegerType()),
])
CALL_T = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("loop_depth", T.IntegerType()),
])
FACT_FIELDS = [
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_line", T.IntegerType()),
    T.StructField("node_count", T.IntegerType()),
    T.StructField("functions", T.ArrayType(FUNCTION_T)),
    T.StructField("classes", T.ArrayType(CLASS_T)),
    T.StructField("imports", T.ArrayType(IMPORT_T)),
    T.StructField("calls", T.ArrayType(CALL_T)),
]

_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_IMPORTS = (ast.Import, ast.ImportFrom)
_AST = ast.AST
_CTX = (ast.Load, ast.Store, ast.Del)
_NAME, _CONST = ast.Name, ast.Constant
_COMPS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    return None


def _extract(tree: ast.AST) -> tuple[int, list, list, list, list]:
    """One pass over the tree: functions (with complexity), classes, imports, calls, node count.

    Complexity (our rule, SURVEY C7): 1 + If, IfExp, Assert, except handler, loop (+1 with an
    ``else``), comprehension (+1 per ``if``), boolean operator (operands − 1), match case — counted
    in the function's own code, not in nested functions, classes or lambdas. A call's loop depth
    counts the loops and comprehensions around it inside its function.
    """
    functions, classes, imports, calls = [], [], [], []
    count = 0
    # breadth first, like ast.walk, so lists come out in the reference's order;
    # entries: node, enclosing function record (or None), loop depth, place of the class it stands in directly
    stack = deque([(tree, None, 0, None)])
    pop, push = stack.popleft, stack.append
    for_types, if_types = _LOOPS, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)
    while stack:
        node, fn, depth, owner = pop()
        count += 1
        cls = node.__class__
        child_fn, child_depth, place = fn, depth, None
        if cls is ast.FunctionDef or cls is ast.AsyncFunctionDef:
            rec = {"name": node.name, "line": node.lineno, "end_line": node.end_lineno,
                   "args": [a.arg for a in node.args.args],
                   "decorators": [d.id if d.__class__ is ast.Name else ast.unparse(d) for d in node.decorator_list],
                   "is_async": cls is ast.AsyncFunctionDef, "complexity": 1, "owner": owner}
            functions.append(rec)
            child_fn, child_depth = rec, 0
        elif cls is ast.ClassDef:
            place = len(classes)
            classes.append({"name": node.name, "line": node.lineno, "end_line": node.end_lineno})
            child_fn = None
        elif cls is ast.Lambda:
            child_fn, child_depth = None, 0
        elif cls in _IMPORTS:
            base, level = getattr(node, "module", None), getattr(node, "level", None)
            imports += [{"module": base or "" if level is not None else a.name, "name": a.name if level is not None else None, "alias": a.asname,
                         "level": level or 0, "nth": nth, "line": node.lineno} for nth, a in enumerate(node.names)]
        elif cls is ast.Call:
            name = _dotted(node.func)
            if name:
                calls.append({"name": name, "line": node.lineno, "loop_depth": depth})
        if fn is not None:
            if cls in if_types:
                fn["complexity"] += 1
            elif cls in for_types:
                fn["complexity"] += 2 if node.orelse else 1
            elif cls is ast.comprehension:
                fn["complexity"] += 1 + len(node.ifs)
            elif cls is ast.BoolOp:
                fn["complexity"] += len(node.values) - 1
            elif cls is ast.match_case:
                fn["complexity"] += 1
        if cls in for_types:
            child_depth += 1
        elif cls in _COMPS:
            child_depth += len(node.generators)
        # leaves (names, constants, contexts) are counted here instead of being pushed
        for field in node._fields:
            v = getattr(node, field, None)
            if v.__class__ is list:
                for x in v:
                    xc = x.__class__
                    if xc is _NAME:
                        count += 2
                    elif xc is _CONST or xc in _CTX:
                        count += 1
                    elif isinstance(x, _AST):
                        push((x, child_fn, child_depth, place))
            elif v is not None:
                vc = v.__class__
                if vc is _NAME:
                    count += 2
                elif vc is _CONST or vc in _CTX:
                    count += 1
                elif isinstance(v, _AST):
                    push((v, child_fn, child_depth, place))
    calls.sort(key=lambda c: (c["line"], c["name"]))
    return count, functions, classes, imports, calls


def parse_source(source: str | None) -> dict:
    """Facts of one file. Never raises: failures become ``status='error'`` with a message."""
    empty = {"status": "error", "error": None, "error_line": None, "node_count": None,
             "functions": None, "classes": None, "imports": None, "calls": None}
    if source is None:
        return {**empty, "error": "unreadable file"}
    try:
        tree = ast.parse(source)
        count, functions, classes, imports, calls = _extract(tree)
        return {"status": "success", "error": None, "error_line": None, "node_count": count,
                "functions": functions, "classes": classes, "imports": imports, "calls": calls}
    except SyntaxError as e:
        return {**empty, "error": f"Syntax error at line {e.lineno}: {e.msg}", "error_line": e.lineno}
    except (ValueError, RecursionError, MemoryError, OverflowError) as e:
        return {**empty, "error": str(e) or type(e).__name__}


def is_valid_python(source: str | None) -> bool:
    """Does the text parse? (False also for null bytes and runaway nesting.)"""
    if source is None:
        return False
    try:
        ast.parse(source)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False


MEMO_BYTES = 32 << 20  # texts and facts that a worker remembers, as charged below; changes cost only
RECORD_BYTES = 1024    # charged for a text and for each of its records: a dictionary with its numbers and names


class _Memo:
    """Facts of contents seen before, oldest dropped first, bounded by the bytes of their texts and records."""

    def __init__(self):
        self.facts: OrderedDict = OrderedDict()
        self.size = 0

    @staticmethod
    def _bytes(source, facts) -> int:
        records = sum(len(facts[k] or ()) for k in ("functions", "classes", "imports", "calls"))
        return len(source) + RECORD_BYTES * (1 + records)

    def __call__(self, source):
        if source is None or len(source) > MEMO_BYTES // 64:
            return parse_source(source)
        found = self.facts.get(source)
        if found is None:
            found = self.facts[source] = parse_source(source)
            self.size += self._bytes(source, found)
            while self.size > MEMO_BYTES:
                self.size -= self._bytes(*self.facts.popitem(last=False))
        else:
            self.facts.move_to_end(source)
        return found


def _make_parser(carry: list[str], content_col: str):
    fact_names = [f.name for f in FACT_FIELDS]

    def run(batches):
        parse = _Memo()
        for pdf in batches:
            # AST nodes form no reference cycles: refcounting frees each tree, so the cyclic
            # collector only burns time rescanning millions of fresh nodes (about half the parse)
            gc.disable()
            try:
                facts = [parse(src) for src in pdf[content_col]]
            finally:
                gc.enable()
            out = pdf[carry].copy() if carry else pd.DataFrame(index=pdf.index)
            for name in fact_names:
                out[name] = [f[name] for f in facts]
            yield out
    return run


def parse_files(files: DataFrame, carry: list[str] | None = None, content_col: str = "content",
                partitions: int | None = None) -> DataFrame:
    """``file_facts``: one row per file with the ``carry`` columns plus the parsed facts.

    ``content`` goes into the Python worker but not out of it. A small input (see
    ``sources.tables.few_splits``; one unsplittable file, T10) is hash partitioned on the
    carried keys first; a real corpus scan is already split by the reader.
    """
    carry = list(carry or ["repo_id", "path"])
    # partitions=0: the caller has already partitioned the input
    if partitions is None and few_splits(files):
        partitions = files.sparkSession.sparkContext.defaultParallelism
    src = files.select(*carry, content_col)
    if partitions:
        src = src.repartition(partitions, *[c for c in carry if c in ("repo_id", "path")] or carry)
    schema = T.StructType([files.schema[c] for c in carry] + FACT_FIELDS)
    return src.mapInPandas(_make_parser(carry, content_col), schema)


def syntax_ok_udf(null_passes: bool = False):
    """C6 as an Arrow ``pandas_udf`` returning BOOLEAN.

    With ``null_passes`` a null input gives a null result (the caller has already decided those
    rows natively) instead of False.
    """
    if null_passes:
        @F.pandas_udf(T.BooleanType())
        def syntax_ok_nullable(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else is_valid_python(x)).astype("boolean")
        return syntax_ok_nullable

    @F.pandas_udf(T.BooleanType())
    def syntax_ok(s: pd.Series) -> pd.Series:
        return s.map(is_valid_python).astype(bool)
    return syntax_ok


def explode_functions(facts: DataFrame, include_async: bool = False) -> DataFrame:
    """C1 table: FunctionDef only by default (the reference skips ``async def``)."""
    df = facts.select("repo_id", "path", F.explode("functions").alias("f"))
    if not include_async:
        df = df.filter(~F.col("f.is_async"))
    return df.select("repo_id", "path", "f.*").drop("owner")


def explode_classes(facts: DataFrame) -> DataFrame:
    """C2 table: classes with the names of the plain functions directly in their bodies."""
    rows = facts.select("repo_id", "path", "functions", F.posexplode("classes").alias("_place", "c"))
    own = F.filter("functions", lambda f: (f["owner"] == F.col("_place")) & ~f["is_async"])
    return rows.select("repo_id", "path", "c.*", F.transform(own, lambda f: f["name"]).alias("methods"))


def explode_import_names(facts: DataFrame) -> DataFrame:
    """Every imported name: (repo_id, path, module, name, alias, level, nth, line)."""
    return facts.select("repo_id", "path", F.explode("imports").alias("i")).select("repo_id", "path", "i.*")


def explode_imports(facts: DataFrame) -> DataFrame:
    """C3 table: the modules of ``import`` statements, the module of each ``from`` statement once."""
    return explode_import_names(facts).where(F.col("name").isNull() | (F.col("nth") == 0)).select("repo_id", "path", "module")


def explode_calls(facts: DataFrame) -> DataFrame:
    return facts.select("repo_id", "path", F.explode("calls").alias("c")).select("repo_id", "path", "c.*")


def parse_errors(facts: DataFrame) -> DataFrame:
    """One row per file that did not parse."""
    return facts.filter(F.col("status") == "error").select("repo_id", "path", "error", "error_line")
