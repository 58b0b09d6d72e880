"""Survival analysis of device panels, expressed as Spark plans."""

from hazardloom.columns import PANEL, PanelColumns

__all__ = ["PANEL", "PanelColumns"]
