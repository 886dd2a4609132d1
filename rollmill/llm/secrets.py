"""Secret scans: all rules in one automaton, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.llm.automaton import Automaton, parse
from rollmill.llm.common import documents

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `head` and `least` ask for so many characters behind the longest match of head.

    Lengths belong there: counted repeats of several rules multiply the automaton's states.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    head: str | None = None
    least: int = 0


# The patterns of the base kinds.
ASSIGN_HEAD = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=\-]+", True, ASSIGN_HEAD, 12),
    Rule("access", r"AKIA[A-Z0-9]+", head="AKIA", least=14),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", head="gh[oprsu]_", least=30),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", head="eyJ", least=24),
    Rule("pem", r"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----"),
)


class Scanner:
    """The rules' automaton, and for each rule one that reads backwards from an end to its start.

    For rules whose longest match from a place is the one a backtracking search takes, the spans are
    those of a leftmost search without overlaps, per rule.
    """

    def __init__(self, rules: Iterable[Rule] = BASE_RULES + MORE_RULES):
        self.rules = tuple(rules)
        trees = [parse(r.pattern, r.ignore_case) for r in self.rules]
        self.all = Automaton(trees, anchored=False)
        self.back = [Automaton([t], anchored=True, backwards=True) for t in trees]
        self.heads = [r.head and Automaton([parse(r.head, r.ignore_case)], anchored=True) for r in self.rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, end exclusive, in this order."""
        state, step, least = 0, self.all.step, self.all.first_accept
        hits = []
        for i, c in enumerate(self.all.symbols(text)):
            state = step[state + c]
            if state >= least:
                hits.append((i, state))
        if not hits:
            return []
        matched = [(i, self.all.accepts[s // self.all.width]) for i, s in hits]
        found = []
        for k in range(len(self.rules)):
            at = [i for i, rules in matched if k in rules]
            free = 0  # where the last match ended
            data = head = None
            for i, after in zip(at, at[1:] + [-1]):
                if after == i + 1:
                    continue  # the match goes on
                data = data or self.back[k].symbols(text)
                start = self.back[k].longest(data, i, free - 1)
                if start is None:
                    continue
                start += 1
                free = i + 1
                if self.heads[k]:
                    head = head or self.heads[k].symbols(text)
                    if free - self.heads[k].longest(head, start, free) < self.rules[k].least:
                        continue
                found.append((start, k, free))
        return sorted(found)


def secret_spans(docs: DataFrame, rules: Iterable[Rule] = BASE_RULES + MORE_RULES, text: str = "text") -> DataFrame:
    """All rows and columns with `spans`, the secrets of the whole text by start, then rule.

    The rules' regular expressions become one automaton by subset construction, minimised to one
    transition array; a text is read once, a byte per code point, whatever the number of rules. Offsets
    are code points, end exclusive. A null or empty text has no spans; a column named spans is replaced.
    No rows give no rows. There is no shuffle: repeated rows and hot sources cost what other rows do.
    """
    rules = tuple(rules)
    kinds = [r.kind for r in rules]
    scanner = Scanner(rules)
    keep = docs.drop("spans")
    schema = T.StructType([*keep.schema.fields, T.StructField("spans", SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"kind": kinds[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] if t else []
                for t in batch.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    return keep.mapInArrow(scan, schema)


def of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def told(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark, sf_dir):
    base = [r.kind for r in BASE_RULES]
    found = secret_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    return found.select(
        "doc_id",
        *[F.size(of_kinds("spans", k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(told(of_kinds("spans", *base)), 256).alias("base_sha256"),
        told("spans").alias("spans"),
    )
