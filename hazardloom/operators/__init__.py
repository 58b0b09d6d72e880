"""Panel, survival and scoring operators."""
