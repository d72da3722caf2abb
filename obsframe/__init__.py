"""Spark DataFrame operators for dated, entity-keyed digit-code observations."""

from obsframe.layout import CODES, DIGITS, PAIR_POSITIONS, POSITIONS

__all__ = ["CODES", "DIGITS", "PAIR_POSITIONS", "POSITIONS"]
