"""Seeded random numbers that do not depend on NumPy's version: splitmix64 seeding, xoshiro256**."""

from __future__ import annotations

import math

MASK = 2**64 - 1


def _left(x: int, k: int) -> int:
    return (x << k | x >> (64 - k)) & MASK


class Random:
    def __init__(self, seed: int) -> None:
        self.state, z = [], seed & MASK
        for _ in range(4):
            z = (z + 0x9E3779B97F4A7C15) & MASK
            x = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
            self.state.append(x ^ x >> 31)
        self.spare: float | None = None

    def bits(self) -> int:
        s = self.state
        out = _left(s[1] * 5 & MASK, 7) * 9 & MASK
        t = s[1] << 17 & MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = _left(s[3], 45)
        return out

    def uniform(self) -> float:
        return (self.bits() >> 11) / 2**53

    def exponential(self, mean: float = 1.0) -> float:
        return -mean * math.log(1 - self.uniform())

    def gamma(self, shape: float, scale: float = 1.0) -> float:
        """By squeezing a cubed normal (Marsaglia, Tsang, 2000); shapes under one by a power of a uniform."""
        if shape < 1:
            return self.gamma(shape + 1, scale) * (1 - self.uniform()) ** (1 / shape)
        d = shape - 1 / 3
        c = 1 / math.sqrt(9 * d)
        while True:
            x = self.normal()
            v = (1 + c * x) ** 3
            if v > 0 and math.log(1 - self.uniform()) < 0.5 * x * x + d - d * v + d * math.log(v):
                return d * v * scale

    def jump(self) -> None:
        """Ahead by 2^128 numbers: a stream that does not meet this one."""
        # fixed values: the jump polynomial as published with the generator
        got = [0, 0, 0, 0]
        for word in (0x180EC6D33CFD0ABA, 0xD5A61266F0C9392C, 0xA9582618E03FC9AA, 0x39ABDC4529B1661C):
            for b in range(64):
                if word >> b & 1:
                    got = [x ^ y for x, y in zip(got, self.state, strict=True)]
                self.bits()
        self.state = got

    def below(self, n: int) -> int:
        return self.bits() % n

    def normal(self, mean: float = 0.0, deviation: float = 1.0) -> float:
        if self.spare is not None:
            x, self.spare = self.spare, None
            return mean + deviation * x
        while True:
            u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            s = u * u + v * v
            if 0 < s < 1:
                f = math.sqrt(-2 * math.log(s) / s)
                self.spare = v * f
                return mean + deviation * u * f
