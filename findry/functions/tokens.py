"""Expressions over token arrays: cropping, augmentation, borders, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findry.functions.rand import hash_order, uniform, uniform_of
from findry.functions.text import let


def random_crop(
    tokens: Column, lo: float, hi: float, seed: int | str, key: Column
) -> Column:
    """A run of random length and start.

    The length is the floor of the size times a uniform number in [lo, hi);
    the start is uniform over all positions that fit.
    """
    n = F.size(tokens)
    ratio = F.lit(lo) + (hi - lo) * uniform(f"{seed}-ratio", key)
    length = F.floor(n * ratio).cast("int")
    start = F.floor((n - length + 1) * uniform(f"{seed}-start", key)).cast("int")
    return F.slice(tokens, start + 1, length)


def _draw(seed: int | str, key: Column, index: Column) -> Column:
    return uniform_of(hash_order(seed, key, index))


def mask_tokens(tokens: Column, p: float, mask_id: int, seed: int | str, key: Column) -> Column:
    """Each token becomes the mask id with probability ``p``."""
    return F.transform(
        tokens, lambda t, i: F.when(_draw(seed, key, i) > p, t).otherwise(F.lit(mask_id))
    )


def replace_tokens(
    tokens: Column, p: float, low: int, high: int, seed: int | str, key: Column
) -> Column:
    """Each token becomes a random id in [low, high] with probability ``p``."""

    def swap(t: Column, i: Column) -> Column:
        pick = F.lit(low) + F.floor(_draw(f"{seed}-pick", key, i) * (high - low + 1)).cast("int")
        return F.when(_draw(seed, key, i) > p, t).otherwise(pick)

    return F.transform(tokens, swap)


def delete_tokens(tokens: Column, p: float, seed: int | str, key: Column) -> Column:
    """Each token is dropped with probability ``p``."""
    return F.filter(tokens, lambda t, i: _draw(seed, key, i) > p)


def shuffle_tokens(tokens: Column, p: float, seed: int | str, key: Column) -> Column:
    """A random subset (each position with probability ``p``) is permuted in place."""
    marked = F.transform(
        tokens,
        lambda t, i: F.struct(
            hash_order(f"{seed}-order", key, i).alias("order"),
            (_draw(seed, key, i) < p).alias("moves"),
            i.alias("place"),
            t.alias("token"),
        ),
    )

    def permute(all_tokens: Column) -> Column:
        moving = F.filter(all_tokens, lambda m: m["moves"])
        staying = F.filter(all_tokens, lambda m: ~m["moves"])
        # the j-th moving place receives the j-th token of the shuffled subset
        moved = F.zip_with(
            moving,
            F.array_sort(moving),
            lambda to, source: F.struct(to["place"].alias("place"), source["token"].alias("token")),
        )
        stayed = F.transform(staying, lambda m: F.struct(m["place"], m["token"]))
        return F.transform(F.sort_array(F.concat(moved, stayed)), lambda m: m["token"])

    return let(marked, permute)


def augment(
    tokens: Column,
    kind: str,
    p: float,
    seed: int | str,
    key: Column,
    mask_id: int = 103,
    low: int = 0,
    high: int = 30521,
) -> Column:
    """One of the augmentations by name; ``none`` leaves the tokens alone."""
    if kind == "mask":
        return mask_tokens(tokens, p, mask_id, seed, key)
    if kind == "replace":
        return replace_tokens(tokens, p, low, high, seed, key)
    if kind == "delete":
        return delete_tokens(tokens, p, seed, key)
    if kind == "shuffle":
        return shuffle_tokens(tokens, p, seed, key)
    if kind == "none":
        return tokens
    raise ValueError(f"unknown augmentation {kind!r}")


def add_bos_eos(tokens: Column, bos: int | None, eos: int | None) -> Column:
    """Add the begin and end tokens that are defined."""
    parts = []
    if bos is not None:
        parts.append(F.array(F.lit(bos)))
    parts.append(tokens)
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return F.concat(*parts) if len(parts) > 1 else tokens


def pad_to(tokens: Column, length: Column) -> Column:
    """Append zeros up to ``length``."""
    return F.concat(tokens, F.array_repeat(F.lit(0), length - F.size(tokens)))


def mask_to(tokens: Column, length: Column) -> Column:
    """Ones for tokens, zeros for padding."""
    return F.concat(
        F.array_repeat(F.lit(1), F.size(tokens)),
        F.array_repeat(F.lit(0), length - F.size(tokens)),
    )
