"""SentencePiece (BPE) encoding and decoding by a table of last tokens.

The encoding of a text is the one sequence of tokens in which every neighbouring pair is compatible: encoding the two
joined gives the two again. So each prefix of a text has one last token. The table is filled from left to right: an automaton
finds the tokens that end at a place, and the one compatible with the last token of the prefix before it is kept. The ids
are then read backwards from the end. Nothing crosses from a visible character to a space mark, so texts are cut there first; the
distinct words of a batch are filled together, place by place, and their encodings are kept in a bounded cache.

Defined results. Null and empty texts have no ids and decode to the empty text. Characters without a token become
their UTF-8 bytes' tokens. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import short_batches, texts
from ledgerlark.llm.media import runs

SPACE = "▁"
#: Words that a generation of the cache holds, and characters of texts whose words are resolved together.
CACHED, TOGETHER = 150_000, 1_000_000
#: The table of answers on pairs has two to this power of slots.
KEPT_BITS = 20
#: Longer words are not filled in step with others.
LONG = 48
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


class PrefixTable:
    """Exact BPE encoder and decoder of one model.

    Merges are made by score, the leftmost of equals. Where a piece is merged from pieces with better scores, whether it is compatible
    with another follows from undoing their merges from the last one on; the few pieces that are not (loose: as runs of spaces, which
    share one score) are merged anew with their neighbour.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalization are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.none = len(self.pieces)  # stands for a character without a piece
        self.text_of = [str(i) for i in range(self.none)]
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self._order()
        self._automaton()

    def _order(self) -> None:
        """Ranks of pieces (0: single characters) and the two pieces that each is merged from last."""
        many = sorted((p for p in self.id_of if len(p) > 1), key=lambda p: -self.score[p])
        steps = {s: n for n, s in enumerate(dict.fromkeys(self.score[p] for p in many), 1)}
        self.never = len(steps) + 2
        self.rank = [0] * (self.none + 1)
        for p in many:
            self.rank[self.id_of[p]] = self.never  # until its turn: no piece is merged from ones that come later
        self.first, self.second = list(range(self.none + 1)), list(range(self.none + 1))
        self.made: dict[int, int] = {}  # pair of tokens -> rank of what they merge to
        self.loose: set[int] = set()
        for p in many:
            i = self.id_of[p]
            rank = self.rank[i] = steps[self.score[p]]
            cuts = [(self.id_of[p[:k]], self.id_of[p[k:]]) for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
            last = next(((a, b) for a, b in cuts if max(self.rank[a], self.rank[b]) < rank and self.loose.isdisjoint((a, b)) and self._fit(a, b)), None)
            if last:
                self.first[i], self.second[i] = last
            else:
                self.loose.add(i)
            self.made |= {a << 32 | b: rank for a, b in ([last] if last else cuts)}
        keys = np.array(sorted(self.made), np.int64)
        self.pair_keys, self.pair_ranks = np.append(keys, -1), np.append(np.array([self.made[k] for k in keys.tolist()], np.int32), 0)
        self.ranks, self.firsts, self.seconds = (np.array(x, np.int32) for x in (self.rank, self.first, self.second))
        self.is_loose = np.zeros(self.none + 1, bool)
        self.is_loose[list(self.loose)] = True
        self.kept_keys, self.kept = np.full(1 << KEPT_BITS, -1, np.int64), np.zeros(1 << KEPT_BITS, bool)

    def _merged(self, text: str) -> list[str]:
        """Best-scored merges first, the leftmost of equals: for loose pieces and pairs with them, which are short."""
        out, score = list(text), self.score
        while True:
            found = [(-score[out[i] + out[i + 1]], i) for i in range(len(out) - 1) if out[i] + out[i + 1] in score]
            if not found:
                return out
            at = min(found)[1]
            out[at : at + 2] = [out[at] + out[at + 1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether encoding two tokens joined gives the two again: no pair across the cut would have merged sooner than what is undone."""
        if not self.loose.isdisjoint((left, right)):
            return self.none in (left, right) or self._merged(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]
        rank, limit = self.rank, self.never
        while self.made.get(left << 32 | right, limit) >= limit:
            if rank[left] > rank[right]:
                limit, left = rank[left], self.second[left]
            elif rank[right]:
                limit, right = rank[right] + 1, self.first[right]
            else:
                return True
        return False

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_fit() of many pairs in step."""
        out = np.ones(len(left), bool)
        for k in np.flatnonzero(self.is_loose[left] | self.is_loose[right]).tolist():
            out[k] = self._fit(int(left[k]), int(right[k]))
        at = np.flatnonzero(~(self.is_loose[left] | self.is_loose[right]))
        left, right, limit = left[at], right[at], np.full(len(at), self.never, np.int32)
        while len(at):
            key = left.astype(np.int64) << 32 | right
            found = np.searchsorted(self.pair_keys[:-1], key)
            merged = np.where(self.pair_keys[found] == key, self.pair_ranks[found], self.never)
            sooner, a, b = merged < limit, self.ranks[left], self.ranks[right]
            out[at[sooner]] = False
            of_left = a > b
            go = np.flatnonzero(~sooner & (of_left | (b > 0)))
            at, of_left, left, right = at[go], of_left[go], left[go], right[go]
            limit = np.where(of_left, a[go], b[go] + 1)
            left, right = np.where(of_left, self.seconds[left], left), np.where(of_left, right, self.firsts[right])
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens are compatible; answers are kept in a table of fixed size, a newer pair in place of an older one."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key * np.int64(0x2545F4914F6CDD1D)).view(np.uint64) >> np.uint64(64 - KEPT_BITS)).view(np.int64)
        out = self.kept[slot]
        new = np.flatnonzero(self.kept_keys[slot] != key)
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            fits = self._fits((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
            out[new] = fits[which]
            order = np.argsort(slot[new], kind="stable")  # one pair for each slot
            one = new[order[np.flatnonzero(np.diff(slot[new][order], append=-1))]]
            self.kept_keys[slot[one]], self.kept[slot[one]] = key[one], out[one]
        return out

    def _automaton(self) -> None:
        """All pieces that end at each place of a text: a tree of their characters with links to shorter suffixes."""
        chars = sorted({c for p in self.id_of for c in p})
        if any(c not in self.id_of for c in chars):
            raise ValueError("a character of the pieces is no piece itself")
        self.width = len(chars) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, self.width)
        classes = {c: n for n, c in enumerate(chars, 1)}
        self.next: dict[int, int] = {}  # state * width + class -> state
        own, depth = [self.none], [0]
        for p, i in self.id_of.items():
            at = 0
            for c in p:
                key = at * self.width + classes[c]
                to = self.next.get(key)
                if to is None:
                    to = self.next[key] = len(own)
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            if i not in self.loose or self._merged(p) == [p]:  # others never come out of an encoding
                own[at] = i
        keys = np.array(sorted(self.next), np.int64)
        self.next_keys, self.next_states = np.append(keys, -1), np.append(np.array([self.next[k] for k in keys.tolist()], np.int32), 0)
        self.back = np.zeros(len(own), np.int32)
        self.own = np.array(own, np.int32)
        depths = np.array(depth)
        up, char, states = keys // self.width, keys % self.width, self.next_states[:-1]
        self.link = np.zeros(len(own), np.int32)  # the longest shorter suffix that is a piece
        self.start = np.where(self.own >= 0, np.arange(len(own)), 0).astype(np.int32)  # the state itself if it is a piece, else its link
        for d in range(1, max(depth) + 1):  # by depth: a state's shorter suffix is complete before it
            here = np.flatnonzero(depths[states] == d)
            if d > 1:
                self.back[states[here]] = self._step(self.back[up[here]], char[here])
            at = states[here]
            self.link[at] = self.start[self.back[at]]
            self.start[at] = np.where(self.own[at] >= 0, at, self.link[at])
        self.size = np.array([len(p) for p in self.pieces] + [1], np.int32)
        self.lists = [x.tolist() for x in (self.back, self.own, self.link, self.start, self.size)]

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        out, at = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(at):
            key = state.astype(np.int64) * self.width + char
            found = np.searchsorted(self.next_keys[:-1], key)
            hit = self.next_keys[found] == key
            out[at[hit]] = self.next_states[found[hit]]
            rest = np.flatnonzero(~hit & (state > 0))
            at, char, state = at[rest], char[rest], self.back[state[rest]]
        return out

    def segment(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word, self.none for characters without a piece. Short words are filled in step, place by place; long ones each by itself."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._segment_long(words[k])
        order = np.argsort(-sizes, kind="stable")
        order = order[np.count_nonzero(sizes > LONG) :]
        if not len(order):
            return out
        sizes = sizes[order]
        ranked = order.tolist()
        char = self.class_of[np.frombuffer("".join([words[k] for k in ranked]).encode("utf-32-le"), "<u4")]
        begin = np.cumsum(sizes) - sizes
        last, state = np.empty(len(char), np.int32), np.zeros(len(order), np.int32)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # words longer than each place
        for place, n in enumerate(live.tolist()):
            at = begin[:n] + place
            state = self._step(state[:n], char[at])
            piece = self.start[state]
            while len(at):
                token = self.own[piece]
                size = self.size[token]
                good = size == place + 1
                inner = np.flatnonzero(~good)
                good[inner] = self.compatible(last[at[inner] - size[inner]], token[inner])
                last[at[good]] = token[good]
                rest = np.flatnonzero(~good)
                at, piece = at[rest], self.link[piece[rest]]
        ends, at, here = np.zeros(len(char), bool), begin + sizes - 1, begin
        while len(at):  # backwards from the end
            ends[at] = True
            at = at - self.size[last[at]]
            more = np.flatnonzero(at >= here)
            at, here = at[more], here[more]
        tokens = last[ends].tolist()
        counts = np.add.reduceat(ends.astype(np.int64), begin).tolist()
        a = 0
        for k, n in zip(ranked, counts, strict=True):
            out[k] = tokens[a : a + n]
            a += n
        return out

    def _segment_long(self, word: str) -> list[int]:
        """segment() of one word, with the answers on pairs kept for it."""
        back, own, link, start, sizes = self.lists
        known: dict[int, bool] = {}
        last, state, width = [self.none] * (len(word) + 1), 0, self.width
        for end, char in enumerate(self.class_of[np.frombuffer(word.encode("utf-32-le"), "<u4")].tolist(), 1):
            to = self.next.get(state * width + char)
            while to is None and state:
                state = back[state]
                to = self.next.get(state * width + char)
            state = to or 0
            piece = start[state]
            while True:
                token = own[piece]
                before = last[end - sizes[token]]
                key = before << 32 | token
                fits = True if end == sizes[token] else known.get(key)
                if fits is None:
                    fits = known[key] = self._fit(before, token)
                if fits:
                    last[end] = token
                    break
                piece = link[piece]
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        ids.reverse()
        return ids

    def ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: characters without a piece become the tokens of their UTF-8 bytes."""
        out = self.segment(words)
        for k, tokens in enumerate(out):
            if self.none in tokens:
                at, found = 0, []
                for i in tokens:
                    found += [i] if i < self.none else [self.id_of_byte[b] for b in words[k][at].encode()]
                    at += len(self.pieces[i]) if i < self.none else 1
                out[k] = found
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """Cut a whole text before its space marks; each word's first mark is left out."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return [w[1:] for w in _RUN.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        return [i for found in self.ids([SPACE + w for w in self.words(text)]) for i in found]

    def decode(self, ids) -> str:
        """Text of ids: runs of byte tokens are read as UTF-8, each bad byte as U+FFFD; one leading space mark goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids])
            return (text[1:] if text[:1] == SPACE else text).replace(SPACE, " ")
        out, run = [], bytearray()
        for n, i in enumerate(ids):
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            piece = self.pieces[i]
            out.append(piece[1:] if n == 0 and piece[0] == SPACE else piece)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out).replace(SPACE, " ")


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Digester:
    """Ids and decoded texts word by word: each distinct word of a batch is resolved once, and kept in a cache of bounded size.

    The cache has two generations, so that words in use stay: word -> (ids as text, their number, decoded text).
    """

    def __init__(self, path: str):
        self.table = PrefixTable(path)
        self.new: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def __call__(self, whole: list[str]) -> list[tuple[str, int, str]]:
        out = []
        for a, b in runs([len(t) for t in whole], TOGETHER):
            cut = [self.table.words(t) for t in whole[a:b]]
            self._learn(set().union(*cut))
            for words in cut:
                if words:
                    ids, n, decoded = zip(*map(self.new.__getitem__, words), strict=True)
                    # every word begins with a space mark, of which decoding drops the text's first
                    out.append((",".join(ids), sum(n), "".join(decoded)[1:]))
                else:
                    out.append(("", 0, ""))
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.new) >= CACHED:
            self.new, self.old = {}, self.new
        missing = words.difference(self.new)
        self.new.update({w: self.old[w] for w in missing.intersection(self.old)})
        unseen = list(missing.difference(self.old))
        table, names, shown = self.table, self.table.text_of, self.table.shown
        tokens = table.ids([SPACE + w for w in unseen])
        for word, ids in zip(unseen, tokens, strict=True):
            if table.byte_of.keys().isdisjoint(ids):
                text = "".join([shown[i] for i in ids])
            else:  # behind a space mark of its own, so that the word's first one is kept
                text = table.decode([table.id_of[SPACE], *ids])
            self.new[word] = ",".join([names[i] for i in ids]), len(ids), text


@cache
def digester_of(path: str) -> Digester:
    """One digester a Python worker, with its cache."""
    return Digester(path)


def encode_documents(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with keep, the ids (as text) and the decoded text too."""
    short_batches(docs.sparkSession)

    def run(batches):
        digest = digester_of(path)
        for batch in batches:
            rows = digest(batch.column(1).to_pylist())
            arrays = [
                batch.column(0),
                pa.array([n for _, n, _ in rows], pa.int64()),
                pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in rows], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in rows], pa.string()),
            ]
            if keep:
                arrays += [pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep)
