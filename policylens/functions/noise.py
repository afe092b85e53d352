"""Row noise that depends only on the row's own key, so no partitioning can change it."""

import math

from pyspark.sql import functions as F

from policylens.functions.rounding import round_half_even


class HashedNoise:
    """Uniform and normal draws from the first 13 digits of the MD5 of key/seed/stream, which other engines can repeat."""

    def __init__(self, seed=42):
        self.seed = seed

    def _unit(self, key, stream):
        # 52 bits of the hash: every value is an exact double in (0, 1).
        spelled = F.concat_ws("/", key.cast("string"), F.lit(str(self.seed)), F.lit(stream))
        bits = F.conv(F.substring(F.md5(spelled), 1, 13), 16, 10).cast("long")
        return (bits.cast("double") + 0.5) / float(2 ** 52)

    def _uniform_int(self, key, stream, low, high):
        return (F.floor(self._unit(key, stream) * (high - low)) + low).cast("int")

    def tenure_jitter(self, key):
        return self._uniform_int(key, "tenure", 0, 6)

    def contact_jitter(self, key):
        return self._uniform_int(key, "contact", 10, 60)

    def premium_change(self, key):
        """Normal(2, 5) by Box-Muller, 1 decimal."""
        radius = F.sqrt(-2.0 * F.log(self._unit(key, "change-radius")))
        angle = 2.0 * math.pi * self._unit(key, "change-angle")
        return round_half_even(2.0 + 5.0 * radius * F.cos(angle), 1)


class ModularNoise:
    """Same ranges by integer arithmetic, for checks that another engine must repeat exactly."""

    def __init__(self, seed=42):
        self.seed = seed

    def _spread(self, key, factor, size):
        return F.pmod(key * factor + self.seed, F.lit(size)).cast("int")

    def tenure_jitter(self, key):
        return self._spread(key, 31, 6)

    def contact_jitter(self, key):
        return self._spread(key, 13, 50) + 10

    def premium_change(self, key):
        return (self._spread(key, 17, 201) - 80) / F.lit(10.0)
