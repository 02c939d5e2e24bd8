"""Specs that are saved, replayed and answered: questions, recipes, codes, report cards."""
