"""Spark-native analytics over histories of number draws."""

from urnstat.games import G5, G6, GameSpec

__all__ = ["G5", "G6", "GameSpec"]
