"""DataFrame operators over reports, findings, entities, sentences and judge answers."""
