"""Random permutations and draws as Columns, without a sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

#: Rounds of the network (an even number restores the halves), and steps after which a walk has ended but for odds of 2 to the minus 64.
MIXES, WALK = 6, 64


def permuted(x: Column, n: int, *key: Column) -> Column:
    """Where the keyed permutation of 0 .. ``n`` - 1 puts ``x``; keys give unrelated permutations.

    A Feistel network permutes the numbers of as many bits as ``n`` needs; whoever lands at ``n`` or beyond goes on
    through it until it is below (fewer than half of all numbers are beyond).
    """
    bits = max(2, (n - 1).bit_length())
    low = bits - bits // 2

    def mix(v: Column, turn: int) -> Column:
        right = low if turn % 2 == 0 else bits - low
        left = bits - right
        r = v.bitwiseAND(F.lit((1 << right) - 1).cast("long"))
        new = F.shiftrightunsigned(v, right).bitwiseXOR(F.xxhash64(*key, F.lit(turn), r)).bitwiseAND(F.lit((1 << left) - 1).cast("long"))
        return F.shiftleft(r, left).bitwiseOR(new)

    def network(v: Column, turn: int = 0) -> Column:
        return v if turn == MIXES else let(mix(v, turn), lambda w: network(w, turn + 1))

    start = network(x.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda v, _: F.when(v < n, v).otherwise(network(v)))


def drawn(n: Column, *key: Column) -> Column:
    """A number from 0 to ``n`` - 1 for each key."""
    return F.pmod(F.xxhash64(*key), n)
