"""Game specs: how many numbers a draw holds and which values are legal."""

from __future__ import annotations

from dataclasses import dataclass

# Set keys pack a combination into one bigint, one bit per number.
KEY_BITS = 62


@dataclass(frozen=True)
class GameSpec:
    name: str
    slots: int
    high: int
    bonus_high: int
    low_cut: int = 25

    def __post_init__(self):
        if not 1 < self.slots <= self.high <= KEY_BITS:
            raise ValueError(f"main domain of {self.name} must fit 1..{KEY_BITS}")

    @property
    def bonus_slot(self) -> int:
        """Slot number of the bonus in (slot, number, p) tables; mains are 1..slots."""
        return self.slots + 1

    def domain_high(self, slot: int) -> int:
        return self.bonus_high if slot == self.bonus_slot else self.high


# Fixed values of the two supported games.
G5 = GameSpec("g5", slots=5, high=50, bonus_high=20)
G6 = GameSpec("g6", slots=6, high=52, bonus_high=52)
