"""panelforge: measurement-panel, event and training-text operators as Spark plans."""
