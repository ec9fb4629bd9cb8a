"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to MAX_ORDER bytes with the counts of the bytes that follow (method C: a context
with n bytes seen, d of them distinct, gives the escape d / (n + d)). An unseen byte escapes to the next shorter context, at last
to 1 of 256. Statistics are frozen after fitting: no context of the trees is cut; each context has the bytes
that follow it in any language as a bit map, whose rank is the row of code lengths. A text's score in a language is its exact code length; the shortest wins.

The trees are fitted on a bounded sample of labelled documents: whole documents in the order of a hash of their id, at most
DOCS_A_LANGUAGE of a language and BYTES_A_LANGUAGE bytes, or an even share of SAMPLE_BYTES if that is less (beyond one document). Documents of more than
BYTES_A_LANGUAGE bytes are only predicted, unless a language has no other: then the beginning of one is learned. Every label is
learned. GROUP languages share a set of contexts, and a byte of the sample adds at most MAX_ORDER + 1 grams of one code length for each of them; that
bounds the broadcast. A language's code lengths do not depend on which others are in its group.

The pipeline keeps a text only if its best language says something about it: the code may take no more bits a byte than ROOM times the
most that any document set aside in fitting took, and never more than the 8 bits of a uniform code; SHORT bits are free.

Defined results. A null text or one without any letter is "und" with score 0. score is the language's posterior from the code
lengths, all languages being as likely before; ties go to the first language in alphabetical order. Repeated rows are predicted alike. Without labelled
documents every text is "und". Labels of the documents that are predicted are never read for that.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import crc32_of_id, short_batches, texts

MAX_ORDER = 4
DOCS_A_LANGUAGE, BYTES_A_LANGUAGE = 300, 600_000
SAMPLE_BYTES, GROUP = 2_400_000, 8
#: Bytes of a lane, and lanes that are stepped together.
LANE, LANES = 256, 4096
UNKNOWN = "und"
#: accepted() keeps documents whose language is at least so likely, with codes bounded by these (see above); one of ASIDE documents is set aside.
LEAST_SCORE = 0.5
ROOM, SHORT, ASIDE, FEWEST = 1.5, 96, 5, 5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    shorter: np.ndarray  # context -> its longest proper suffix; context 0 is the empty one
    escapes: np.ndarray  # context, language -> bits of falling to the shorter context, 0 where the language does not have the context
    after: np.ndarray  # context, quarter of the bytes -> 64 bits: the bytes seen after the context in any language; all after context 0
    first: np.ndarray  # context, quarter -> row of the first such byte
    follow: np.ndarray  # row -> context after the byte
    bits: np.ndarray  # row, language -> code length of the byte after the context


def sample(docs: DataFrame, doc_limit: int = DOCS_A_LANGUAGE, byte_limit: int = BYTES_A_LANGUAGE, total: int = SAMPLE_BYTES) -> list[tuple[str, bytes, int]]:
    """(lang, text, number within the language) of the bounded sample: labelled documents in training folds, in the order of a hash of their id."""
    learn = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter((crc32_of_id(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull())
    bytes_of = F.octet_length("text").cast("long")
    long = bytes_of > byte_limit
    counts = {r[0]: (r[1], r[2]) for r in learn.filter("text is not null").groupBy("lang").agg(F.count_if(~long), F.min(F.when(long, F.xxhash64("doc_id")))).collect()}  # a row a label
    if not counts:
        return []
    even = min(byte_limit, max(1, total // len(counts)))
    # Of each language, the share that gives a little more than the limit; then exactly the first of them.
    names = learn.sparkSession.createDataFrame([(lang, min(1.0, 1.5 * doc_limit / n) if n else 0.0, None if n else least) for lang, (n, least) in counts.items()], "lang string, share double, least long")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    only = F.coalesce(F.xxhash64("doc_id") == F.col("least"), F.lit(False))
    some = learn.join(F.broadcast(names), "lang").filter((~long & (spread < F.col("share"))) | (long & only))
    some = some.select("lang", "doc_id", F.when(long, F.substring("text", 1, even)).otherwise(F.col("text")).alias("text"), F.xxhash64("doc_id").alias("spread"))
    order = Window.partitionBy("lang").orderBy("spread", "doc_id", "text")
    some = some.withColumn("row", F.row_number().over(order)).withColumn("bytes", F.sum(bytes_of).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    some = some.filter((F.col("row") <= doc_limit) & (F.coalesce("bytes", F.lit(0)) < even)).select("lang", "text", "row")
    return sorted((r[0], r[1].encode(), r[2]) for r in some.collect())  # bounded by the limits


def learned(some: list[tuple[str, bytes, int]]) -> list[Model]:
    """Models of all languages of a sample, GROUP languages each, in alphabetical order."""
    names = sorted({lang for lang, _, _ in some})
    groups = [set(names[a : a + GROUP]) for a in range(0, len(names), GROUP)]
    return [fit([(lang, text) for lang, text, _ in some if lang in own]) for own in groups]


def bounded(some: list[tuple[str, bytes, int]]) -> tuple[list[Model], np.ndarray]:
    """Models of a sample without what is set aside, and for each language the most bits a byte that its texts may take."""
    aside = [x for x in some if x[2] % ASIDE == 0 and x[1]]
    models = learned([x for x in some if x[2] % ASIDE])
    languages = [lang for m in models for lang in m.languages]
    bits = code_lengths(models, [text for _, text, _ in aside])
    most = np.full(len(languages), 8.0)
    for k, lang in enumerate(languages):
        own = [row[k] / len(text) for row, (owner, text, _) in zip(bits, aside, strict=True) if owner == lang]
        if len(own) >= FEWEST:
            most[k] = min(8.0, ROOM * max(own))
    return models, most


def grams(whole: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Substrings of a size as big-endian numbers, sorted, with their counts."""
    found = [np.zeros(0, np.int64)]
    for text in whole:
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        if len(data) >= size:
            found.append(sum(data[k : len(data) - size + 1 + k] << (8 * (size - 1 - k)) for k in range(size)))
    return np.unique(np.concatenate(found), return_counts=True)


def fit(labelled: list[tuple[str, bytes]], order: int = MAX_ORDER) -> Model:
    """The whole trees of all languages over one set of contexts. Substrings of a text have their prefixes and suffixes in it too,
    so the set is closed and every gram's shorter form is a gram."""
    languages = sorted({lang for lang, _ in labelled})
    counted = [[grams([t for owner, t in labelled if owner == lang], k) for k in range(1, order + 2)] for lang in languages]
    every = [np.unique(np.concatenate([np.arange(256) if k == 0 else [], *[own[k][0] for own in counted]]).astype(np.int64)) for k in range(order + 1)]
    contexts = [np.unique(codes >> 8) for codes in every]  # contexts[j]: those of j bytes
    start = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    count = int(start[-1])
    shorter, escapes = np.zeros(count, np.int64), np.zeros((count, len(languages)))
    after, keys, follows, costs = np.zeros((count, 4), np.uint64), [], [], []
    for k, codes in enumerate(every):  # grams of k + 1 bytes, after contexts of k bytes
        local = np.searchsorted(contexts[k], codes >> 8)
        seen = np.zeros((len(codes), len(languages)))
        for index, own in enumerate(counted):
            seen[np.searchsorted(codes, own[k][0]), index] = own[k][1]
        total, distinct = np.zeros((2, len(contexts[k]), len(languages)))
        np.add.at(total, local, seen)
        np.add.at(distinct, local, seen > 0)
        escape = np.where(total > 0, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0)
        place = np.searchsorted(every[k - 1], codes & ((1 << 8 * k) - 1)) if k else None
        below = costs[-1][place] if k else 8.0
        costs.append(np.where(seen > 0, np.log2(np.maximum((total + distinct)[local], 1) / np.maximum(seen, 1)), escape[local] + below))
        follow = follows[-1][place] if k else np.zeros(len(codes), np.int64)
        if k < order:
            at = np.minimum(np.searchsorted(contexts[k + 1], codes), max(0, len(contexts[k + 1]) - 1))
            known = contexts[k + 1][at] == codes if len(contexts[k + 1]) else np.zeros(len(codes), bool)
            follow = np.where(known, start[k + 1] + at, follow)
        follows.append(follow)
        own = slice(start[k], start[k + 1])
        escapes[own] = escape
        if k:
            shorter[own] = start[k - 1] + np.searchsorted(contexts[k - 1], contexts[k] & ((1 << 8 * (k - 1)) - 1))
        np.bitwise_or.at(after, (start[k] + local, codes >> 6 & 3), np.uint64(1) << (codes & 63).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(np.bitwise_count(after).ravel(), dtype=np.int64)[:-1]]).reshape(count, 4)
    # Rows are already in the order of context and byte: contexts by length and number, grams by number.
    return Model(languages, shorter, escapes.astype(np.float32), after, first, np.concatenate(follows), np.concatenate(costs).astype(np.float32))


def find(model: Model, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is known after its context, and its row if so."""
    cell = state * 4 + (byte >> 6)
    word, bit = model.after.ravel()[cell], (byte & 63).astype(np.uint64)
    at = model.first.ravel()[cell] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
    return (word >> bit & np.uint64(1)).astype(bool), at


def step(model: Model, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts after a byte in each lane, and the byte's bits (lanes, languages)."""
    known, at = find(model, state, byte)
    missing = np.flatnonzero(~known)
    fallen, spent = state[missing], []
    while len(missing):  # at most MAX_ORDER times: the empty context has all bytes
        spent.append((missing, model.escapes[fallen]))
        fallen = model.shorter[fallen]
        known, at[missing] = find(model, fallen, byte[missing])
        missing, fallen = missing[~known], fallen[~known]
    bits = model.bits[at]
    for lanes, escapes in spent:
        bits[lanes] += escapes
    return model.follow[at], bits


def code_lengths(models: list[Model], whole: list[bytes]) -> np.ndarray:
    """Bits of each text in each language: (texts, languages)."""
    return np.hstack([np.zeros((len(whole), 0)), *[_code_lengths(m, whole) for m in models]])


def _code_lengths(model: Model, whole: list[bytes]) -> np.ndarray:
    """code_lengths() of one model. Texts are cut into lanes that begin MAX_ORDER bytes early."""
    out = np.zeros((len(whole), len(model.languages)))
    owners, starts, sizes, warm = [], [], [], []
    base = MAX_ORDER
    for i, text in enumerate(whole):
        for at in range(0, len(text), LANE):
            owners.append(i)
            starts.append(base + at)
            sizes.append(min(LANE, len(text) - at))
            warm.append(min(at, MAX_ORDER))
        base += len(text)
    data = np.frombuffer(b"\0" * MAX_ORDER + b"".join(whole) + b"\0" * LANE, np.uint8).astype(np.int64)
    for a in range(0, len(owners), LANES):
        owner, start, size, early = (np.array(x[a : a + LANES]) for x in (owners, starts, sizes, warm))
        by_size = np.argsort(-size, kind="stable")
        owner, start, size, early = owner[by_size], start[by_size], size[by_size], early[by_size]
        state = np.zeros(len(owner), np.int64)
        spent = np.zeros((len(owner), len(model.languages)))
        for k in range(-MAX_ORDER, int(size.max())):
            live = int(np.searchsorted(-size, -k, side="left")) if k > 0 else len(owner)  # lanes longer than k come first
            after, bits = step(model, state[:live], data[start[:live] + k])
            if k >= 0:
                spent[:live] += bits
                state[:live] = after
            else:  # a lane's own bytes begin from the context before it, which is no longer than MAX_ORDER
                state = np.where(-k <= early, after, 0)
        np.add.at(out, owner, spent)
    return out


def decide(models: list[Model], whole: list[str], most: np.ndarray | None = None) -> tuple[list[str], list[float]]:
    """Language and score of each text; with the most bits a byte, texts beyond them are in no language."""
    from ledgerlark.llm.media import runs

    languages = [lang for m in models for lang in m.languages]
    lang, score = [UNKNOWN] * len(whole), [0.0] * len(whole)
    for a, b in runs([len(t) for t in whole], LANE * LANES):
        some = [i for i in range(a, b) if languages and any(map(str.isalpha, whole[i]))]
        if some:
            raw = [whole[i].encode() for i in some]
            bits = code_lengths(models, raw)
            chance = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
            chance /= chance.sum(1, keepdims=True)
            for i, best, row, own, text in zip(some, bits.argmin(1).tolist(), chance, bits, raw, strict=True):
                if most is None or own[best] <= most[best] * len(text) + SHORT:
                    lang[i], score[i] = languages[best], float(row[best])
    return lang, score


def predict(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    spark = docs.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(models)  # at most SAMPLE_BYTES * (MAX_ORDER + 1) * GROUP code lengths, most often a tenth

    def run(batches):
        for batch in batches:
            lang, score = decide(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents in a learned language, with all their columns, filtered where they lie: "und", scores under the least and texts
    that no language's code fits go (see the module's text). Null and empty texts go; an empty table stays one."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bounded(sample(docs)))
    short_batches(spark)

    def run(batches):
        for batch in batches:
            models, most = held.value
            lang, score = decide(models, [t or "" for t in batch.column("text").to_pylist()], most)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the training folds of docs (doc_id, text, lang) and predict all of them; held_out marks the fold not learned from."""
    found = predict(docs, learned(sample(docs)))
    return found.select("doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score")
