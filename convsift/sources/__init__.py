"""Readers that turn history exports (row tables, JSON trees, benchmark tables) into normalised relations."""
