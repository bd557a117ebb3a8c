"""The pipeline graph, its rules and session state."""
