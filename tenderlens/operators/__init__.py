"""Relational operators over the contract, budget and text tables."""
