"""Plans made of the operators: the registered queries and the engine."""
