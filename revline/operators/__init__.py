"""DataFrame → DataFrame operators: scope, facts, detectors, rules, policy, prompts, synthesis, fixes, versions."""
