"""Column expressions and Arrow-batched functions shared by the operators."""
