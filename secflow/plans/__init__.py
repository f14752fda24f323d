"""Jobs: detection, correlation, entities, inventory, baselines, search, evidence, evaluation."""
