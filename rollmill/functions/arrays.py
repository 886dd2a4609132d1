"""Token-level expressions: log-prob algebra on columns and row-local array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rollmill.functions.text import ColumnOrName, _col


def kl_k3(cur: ColumnOrName, ref: ColumnOrName) -> Column:
    gap = _col(ref) - _col(cur)
    return F.exp(gap) - gap - 1


def kl_k1(gen: ColumnOrName, ref: ColumnOrName) -> Column:
    return _col(gen) - _col(ref)


def clipped_surrogate(
    cur: ColumnOrName, gen: ColumnOrName | None, adv: ColumnOrName, eps: float = 0.2
) -> Column:
    """min(ratio*adv, clip(ratio)*adv); without generator log-probs the ratio is one."""
    if gen is None:
        return _col(adv)
    ratio = F.exp(_col(cur) - _col(gen))
    clipped = F.least(F.greatest(ratio, F.lit(1 - eps)), F.lit(1 + eps))
    return F.least(ratio * _col(adv), clipped * _col(adv))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def logsumexp_array(values: ColumnOrName) -> Column:
    v = _col(values)
    top = F.array_max(v)
    return top + F.log(_sum(F.transform(v, lambda x: F.exp(x - top))))


def token_logprob(logits: ColumnOrName, token: ColumnOrName) -> Column:
    """Log-softmax of the logits at a zero-based token id; NULL outside the vocabulary."""
    return F.get(_col(logits), _col(token)) - logsumexp_array(logits)


def entropy_array(logits: ColumnOrName) -> Column:
    """Entropy of softmax(logits): log Z minus the mean logit under the distribution."""
    v = _col(logits)
    top = F.array_max(v)
    weights = F.transform(v, lambda x: F.exp(x - top))
    z = _sum(weights)
    mean = _sum(F.transform(v, lambda x: F.exp(x - top) * (x - top))) / z
    return F.log(z) - mean


def pad(ids: ColumnOrName, length: ColumnOrName, pad_id: int, side: str = "right") -> Column:
    """Extend an id array to `length` with `pad_id`: right for completions, left for prompts."""
    filler = F.array_repeat(F.lit(pad_id), F.greatest(_col(length) - F.size(_col(ids)), F.lit(0)))
    if side == "right":
        return F.concat(_col(ids), filler)
    if side == "left":
        return F.concat(filler, _col(ids))
    raise ValueError(f"unknown side {side!r}")


def completion_mask(ids: ColumnOrName, plen: ColumnOrName, pad_id: int) -> Column:
    """One per non-pad id behind the prompt."""
    tail = F.slice(_col(ids), _col(plen) + 1, F.greatest(F.size(_col(ids)), F.lit(1)))
    return F.transform(tail, lambda x: (x != pad_id).cast("int"))


def completion_slice(per_token: ColumnOrName, plen: ColumnOrName) -> Column:
    """Per-token values start at the second token, so plen-1 of them belong to the prompt."""
    return F.slice(_col(per_token), F.greatest(_col(plen), F.lit(1)), F.greatest(F.size(_col(per_token)), F.lit(1)))


@F.arrow_udf(ArrayType(DoubleType()))
def suffix_sums(values: pa.Array) -> pa.Array:
    """Sum from each position to the end of its own array, in linear time.

    NULL entries add nothing, and a position with nothing but NULL from there on gives NULL. Rows are
    summed together, those of up to 2^k entries as one matrix, so that Python runs once per power of two
    and not per row. (A fold that appends to an array copies it at every step.)
    """
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten()  # without the entries of NULL rows
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.where(known, pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), 0.0)
    ends = np.cumsum(sizes)
    totals, seen = np.empty(len(numbers)), np.empty(len(numbers), bool)
    longest = int(sizes.max(initial=0))
    low, high = 0, 1
    while low < longest:
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        width = min(high, longest)
        spot = np.arange(width)
        inside = spot < sizes[rows, None]  # counted from the end of each array
        at = np.where(inside, ends[rows, None] - 1 - spot, 0)
        sums = np.cumsum(np.where(inside, numbers[at], 0.0), axis=1)
        any_known = np.logical_or.accumulate(inside & known[at], axis=1)
        totals[at[inside]], seen[at[inside]] = sums[inside], any_known[inside]
        low, high = high, 2 * high
    offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[~values.is_valid().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, pa.array(totals, pa.float64(), mask=~seen))
