"""From query text to a plan: nodes, syntax, passes and the planner."""
