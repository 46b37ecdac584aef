"""DataFrame operators: series primitives, rules, graph and state."""
