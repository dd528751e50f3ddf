"""License scans: fuzzy search for short notices.

A notice with k permitted edits is split into k + 1 parts: any text within k edits holds one part exactly (pigeonhole).
One Aho-Corasick pass finds all parts of all notices; around each hit the regex library's bounded-error matching
verifies the edits and reports the best span there. Hits of one alignment share their window; windows are never joined, so
notices that stand close together are all found. Of spans of one notice that share half of it or more, the one with the
fewest edits stays, on ties the first. The base phrases are notices without edits, whose only part is their last word; they
match word by word, whatever stands between the words.

Defined results: a null or empty text has no words, no spans and score 0. Repeated rows each get a row.
"""

from __future__ import annotations

import functools
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm import tables

#: label and the words that stand consecutively.
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
#: label, short notice (lower case, single spaces) and permitted edits.
NOTICES = (
    ("mit", "permission is hereby granted, free of charge", 4),
    ("mit", "released under the mit license", 2),
    ("apache", "licensed under the apache license, version 2.0", 4),
    ("gpl", "gnu general public license", 2),
    ("gpl", "under the gpl license", 1),
    ("lgpl", "gnu lesser general public license", 3),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("mpl", "mozilla public license", 2),
    ("cc", "creative commons attribution", 2),
    ("spdx", "spdx-license-identifier:", 1),
    ("copyright", "all rights reserved", 1),
)

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType()), T.StructField("exact_word", T.LongType())])

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def parts(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice cut into edits + 1 parts of almost equal length, with the place of each."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def apart(spans: set[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) by edits and place, each unless it shares more than `most` with one kept before; as (start, end, edits)."""
    kept: list[tuple[int, int, int]] = []  # ascending, each overlapping the next by `most` at most
    for e, a, b in sorted(spans):
        at = bisect_left(kept, (a, b, e))
        if all(min(b, y) - max(a, x) <= most for x, y, _ in kept[max(0, at - 2) : at + 2]):
            kept.insert(at, (a, b, e))
    return kept


class Scanner:
    """Finds spans in one lower-cased text."""

    def __init__(self, base=BASE, notices=NOTICES):
        import ahocorasick
        import regex

        self.seeds = ahocorasick.Automaton()
        wants: dict[str, list] = {}
        edge = "[0-9a-z\\x80-\\U0010ffff]"
        for k, (_, phrase) in enumerate(base):
            gap = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
            exact = regex.compile(f"(?<!{edge})" + gap.join(map(regex.escape, phrase)) + f"(?!{edge})")
            wants.setdefault(phrase[-1], []).append(("base", k, exact))
        for k, (_, notice, edits) in enumerate(notices):
            fuzzy = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}", regex.BESTMATCH)
            for part, place in parts(notice, edits):
                wants.setdefault(part, []).append(("notice", k, fuzzy, place))
        for part, found in wants.items():
            self.seeds.add_word(part, (part, found))
        self.seeds.make_automaton()
        self.base, self.notices = base, notices

    def spans(self, text: str) -> list[tuple[str, int, int, int, bool]]:
        """(label, first, end, edits, base) of every match, in code points; base phrases first, in order of place."""
        phrases, windows = {}, {}
        for last, (part, found) in self.seeds.iter(text):
            first = last - len(part) + 1
            for want in found:
                if want[0] == "base":
                    phrases.setdefault(want[1], want[2])
                else:
                    windows.setdefault(want[1], (want[2], set()))[1].add(first - want[3])
        out = [(self.base[k][0], m.start(), m.end(), 0, True) for k, exact in phrases.items() for m in exact.finditer(text)]
        out.sort(key=lambda s: (s[1], s[0]))
        for k, (fuzzy, places) in windows.items():
            label, notice, edits = self.notices[k]
            found = set()
            for at in places:
                m = fuzzy.search(text, max(0, at - edits), min(len(text), at + len(notice) + edits))
                if m:
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
            out += [(label, a, b, e, False) for a, b, e in apart(found, len(notice) // 2)]
        return out


@functools.cache
def _scanner() -> Scanner:
    return Scanner()


def lower(text: str) -> str:
    """A-Z alone to lower case."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, spans_as: str = "spans", words_as: str = "n_words") -> DataFrame:
    """docs with the number of words of each whole text and its license spans (places in code points); no shuffle.

    exact_word of a span is the number of its first word, from 0, for a base phrase; else null.
    """
    fields = [T.StructField(words_as, T.LongType()), T.StructField(spans_as, T.ArrayType(SPAN))]
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("exact_word", pa.int64())]))

    def kernel():
        scanner = _scanner()

        def work(texts: pa.Array) -> list[pa.Array]:
            n_words, spans = np.zeros(len(texts), np.int64), []
            data, offsets = K.flat(texts)
            for i, j in K.chunks(offsets):
                part, here = K.FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                starts, _ = K.words(part, here, _WORD[part])
                own = np.searchsorted(starts, here)
                n_words[i:j] = np.diff(own)
                body = part.tobytes()
                for k in range(j - i):
                    raw = body[here[k] : here[k + 1]]
                    text = raw.decode("utf-8")
                    found = scanner.spans(text)
                    out = []
                    for label, a, b, edits, base in found:
                        word = None
                        if base:
                            at = a if len(text) == len(raw) else len(text[:a].encode())
                            word = int(np.searchsorted(starts, here[k] + at) - own[k])
                        out.append({"label": label, "start": a, "end": b, "edits": edits, "exact_word": word})
                    spans.append(out)
            return [pa.array(n_words, pa.int64()), pa.array(spans, kind)]

        return work

    return tables.add_columns(docs, text_col, fields, kernel, keep)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, keep=["doc_id"])
    base = F.filter("spans", lambda s: s["exact_word"].isNotNull())

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    sureness = F.transform("spans", lambda s: 1.0 - s["edits"].cast("double") / (s["end"] - s["start"] + s["edits"]).cast("double"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["exact_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["exact_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(sureness), F.lit(0.0)).alias("score"),
    )
