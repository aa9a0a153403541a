"""Training-data operators: one module each; :mod:`photonlake.llm.registry` names their queries."""
