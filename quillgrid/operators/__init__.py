"""Operators over tables of lines, blocks and documents."""
