"""Readers, and views that stand in for layout-model output."""
