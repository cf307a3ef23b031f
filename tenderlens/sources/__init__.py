"""Sources and sinks: feeds, contract tables, budget files, manifests and exports."""
