"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language's dictionary is raw text of that language. A text goes to the language whose dictionary makes it
smallest; the call is marked as rejected when the runner-up is nearly as small.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties go to the language
that sorts first; repeated texts get equal results; with nothing to learn from, everything is ``und``; rows with a
null language are not learned from. Extra columns of the input are kept, but for those with the names of the result, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.llm.common import add_by_text, key_remainder

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageSettings:
    dictionary_bytes: int = 96 << 10  #: of each language's dictionary; bounds the fit and the broadcast
    sample_docs: int = 128  #: expected documents of each language that a dictionary is cut from
    slice_chars: int = 512
    block_bytes: int = 2048  #: texts are compressed in blocks, so that a long text's own history does not decide
    level: int = 3
    min_margin: float = 0.02  #: share by which the runner-up must be larger


def letters(text: str) -> bytes:
    """Lower-case letters with single spaces for all else; empty if there is no letter."""
    body = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return body.encode() if any(map(str.isalpha, body)) else b""


def _coders(dictionaries: dict[str, bytes], level: int) -> dict[str, Callable[[bytes], bytes]]:
    made = {}
    for lang, raw in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return made


def build_dictionaries(slices: dict[str, list[tuple[int, bytes]]], settings: LanguageSettings) -> dict[str, bytes]:
    """Dictionaries from (document, slice of its text) by language, without the slices that another language compresses better.

    The slices of each half of the documents are judged by dictionaries from the other half, so mislabelled or foreign
    passages, which would attract long matches, don't get in. A language that would lose all its slices keeps them.
    """
    coders = [_coders({lang: b" ".join(s for d, s in x if d % 2 != half) for lang, x in slices.items()}, settings.level) for half in (0, 1)]
    out = {}
    for lang, own in slices.items():
        kept = [s for d, s in own if len(coders[d % 2][lang](s)) <= min(len(c(s)) for c in coders[d % 2].values())]
        out[lang] = b" ".join(kept or [s for _, s in own])[-settings.dictionary_bytes :]
    return out


def _share(lengths: list[int], total: int) -> int:
    """The least bound on each length under which they add up to ``total``, or the greatest length."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) >= left:
            return -(-left // (len(lengths) - k))
        left -= n
    return max(lengths, default=0)


def learn_dictionaries(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), modulus: int = 4, held: int = 2) -> dict[str, bytes]:
    """A dictionary for each language of the rows that are not held out.

    Counts by language set a hash threshold for each, so that about ``sample_docs`` documents are read for any one,
    however many rows it has. Slices spread over their whole texts, more a document where there are few, fill the
    dictionary twice over, as some are left out; every document and part of it has its share of what is kept.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (key_remainder("doc_id", modulus) != held))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, settings.sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("dictionary")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(draw < shares[F.col("lang")])
    lengths: dict[str, list[int]] = {lang: [] for lang in counts}
    for r in chosen.select("lang", F.length("text").alias("n")).collect():
        lengths[r.lang].append(r.n)
    bounds = F.create_map(*[F.lit(x) for lang, own in sorted(lengths.items()) for x in (lang, _share(own, 2 * settings.dictionary_bytes))])
    size, wide = F.length("text"), settings.slice_chars
    last = F.greatest(F.ceil(F.least(size, bounds[F.col("lang")]) / wide).cast("int") - 1, F.lit(0))
    start = lambda i: F.floor(i * F.greatest(size - wide, F.lit(0)) / F.greatest(last, F.lit(1))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr("text", start(i.cast("long")) + 1, F.lit(wide)))
    rows = chosen.select("lang", "doc_id", cut.alias("slices")).collect()
    texts: dict[str, list[tuple[float, int, bytes]]] = {lang: [] for lang in counts}
    for d, r in enumerate(sorted(rows, key=lambda r: (r.lang, r.doc_id is None, r.doc_id, r.slices))):
        # places by the golden ratio, so that any run of the slices is spread over documents and their parts
        texts[r.lang] += [((d + i) * 0.6180339887498949 % 1, d, x) for i, s in enumerate(r.slices) if (x := letters(s))]
    return build_dictionaries({lang: [(d, x) for _, d, x in sorted(own)] for lang, own in texts.items()}, settings)


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted (the margin is wide enough)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predictor():
        langs = sorted(shared.value)
        coders = list(_coders(shared.value, settings.level).values())
        step = settings.block_bytes

        def one(text: str | None) -> tuple[str, float, bool]:
            body = letters(text) if text else b""
            if not body or not langs:
                return "und", 0.0, False
            blocks = [body[i : i + step] for i in range(0, len(body), step)]
            sizes = np.array([sum(len(c(b)) for b in blocks) for c in coders], dtype=float)
            best = int(sizes.argmin())
            if len(langs) == 1:
                return langs[0], 1.0, True
            rest = np.delete(sizes, best)
            # sizes in bytes are code lengths, so their differences are log-odds in bits
            odds = np.exp2(-8.0 * np.clip(rest - sizes[best], 0, 100)).sum()
            return langs[best], float(1 / (1 + odds)), bool(rest.min() >= sizes[best] * (1 + settings.min_margin))

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [one(t) for t in texts.to_pylist()]
            return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return work

    return add_by_text(docs, {"lang_pred": "string", "score": "double", "accepted": "boolean"}, predictor)
