"""Reusable DataFrame operators: facts, master, quality, selection, histogram, rollup."""
