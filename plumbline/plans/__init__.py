"""Queries by theme; importing a theme registers its queries."""

from importlib import import_module

THEMES = ["bias", "stats", "gold", "traces", "evidence", "student", "streams"]


def load_all() -> None:
    for theme in THEMES:
        import_module(f"plumbline.plans.{theme}")
