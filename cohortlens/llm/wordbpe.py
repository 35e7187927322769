"""BPE with word ends, by speculating and verifying.

Each word is first cut greedily into the longest tokens of the vocabulary. That proposal is right if and only if each
token is what merging makes of its own characters and no merge crosses the border of two neighbours when the two are
merged by themselves: the first crossing merge of a whole word would also happen in that pair alone. All pairs of
neighbours are tested together, in arrays: from two whole tokens the later of the merges beside the border is undone
again and again, and at each state the pair of symbols at the border must not merge sooner than the merge that ends the
state. Words with a failing pair, and those alone, are merged exactly, by a heap.

The test needs merges inside a token to come in order of rank. Tokens for which they do not, or that merging never
makes, fail it, and their words are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.bpe import vocabulary_file
from cohortlens.llm.common import map_columns, per_task

FILE = "word_bpe_49k.json"
#: Distinct words whose ids a task remembers; beyond it the memory starts anew, with the same results.
REMEMBERED = 200_000
#: Symbols up to which words are proposed and merged in arrays, many words at a time.
SHORT = 48
ROWS = 4096
#: A symbol is a byte, plus 256 if it ends its word.
ENDS, SYMBOLS = 256, 512
NEVER = np.iinfo(np.int64).max >> 2


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A vocabulary with word ends, its ranked merges and a trie of its tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE vocabulary")
        suffix, ids = model.get("end_of_word_suffix") or "", model["vocab"]
        self.ends = ENDS if suffix else 0
        self.names = {i: t for t, i in ids.items()}
        self.size = max(self.names, default=-1) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.makes = np.zeros(len(model["merges"]) + 1, np.int64)
        for r, new in self.rank.values():
            self.makes[r] = new
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.symbol = np.full(SYMBOLS, -1, np.int64)
        self.child: dict[int, int] = {}  # node * SYMBOLS + symbol -> node
        self.token = [-1]
        tokens: list[tuple[list[int], int]] = []
        for t, i in ids.items():
            last = bool(suffix) and t.endswith(suffix) and len(t) > len(suffix)
            letters = t[:-len(suffix)] if last else t
            if all(c in byte for c in letters):
                spelled = [byte[c] for c in letters]
                spelled[-1] += ENDS * last
                tokens.append((spelled, i))
                if len(spelled) == 1:
                    self.symbol[spelled[0]] = i
                node = 0
                for x in spelled:
                    if (step := node * SYMBOLS + x) not in self.child:
                        self.child[step] = len(self.token)
                        self.token.append(-1)
                    node = self.child[step]
                self.token[node] = i
        steps = sorted(self.child)
        self.steps, self.nodes = np.array(steps, np.int64), np.array([self.child[k] for k in steps], np.int64)
        self.tokens = np.array(self.token, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        #: Rank of the merge that makes a token: -1 for a single symbol, NEVER for a token that fails every test.
        self.made = np.full(self.size, NEVER, np.int64)
        for spelled, i in tokens:
            self._derive(spelled, i)

    def merge(self, symbols: list[int], steps: list | None = None) -> list[int]:
        """Exact merging by a heap: always the pair of lowest rank, the leftmost of equals. Unknown symbols are left out."""
        ids = [i for i in self.symbol[symbols].tolist() if i >= 0]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            new = self.rank[a, b][1]
            if steps is not None:
                steps.append((r, a, b))
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (new, ids[after[i]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], new)) in self.rank:
                heapq.heappush(heap, (self.rank[p][0], before[i], *p))
        return [x for x in ids if x >= 0]

    def _derive(self, spelled: list[int], i: int) -> None:
        """Note the last merge that makes a token, if merging its symbols makes it with merges in order of rank."""
        steps: list = []
        if self.merge(spelled, steps) != [i]:
            return
        if not steps:
            self.made[i] = -1
        elif all(x[0] <= y[0] for x, y in zip(steps, steps[1:])):
            self.made[i], self.left[i], self.right[i] = steps[-1]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a and b; NEVER where there is no such merge or one is negative."""
        if not len(self.keys):
            return np.full(a.shape, NEVER)
        key = np.where(b < 0, -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of tokens ``a`` and ``b`` together gives the two again, for each pair."""
        good = (self.made[a] < NEVER) & (self.made[b] < NEVER)
        at = np.flatnonzero(good)
        x, y = a[at], b[at]
        # The rank at which the state ends, doubled; a merge on the right of equal rank comes after one across the border.
        limit = np.full(len(at), 2 * NEVER, np.int64)
        while len(at):
            crossed = 2 * self.pair_ranks(x, y) < limit
            good[at[crossed]] = False
            go = ~crossed & ((self.made[x] >= 0) | (self.made[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            # Undo the later merge; of two of the same rank the right one came later.
            undo = self.made[x] > self.made[y]
            limit = np.where(undo, 2 * self.made[x], 2 * self.made[y] + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, token) of the greedy longest matches, in order of word and place, and which words have none."""
        words, tokens, lost = [], [], np.zeros(len(starts), bool)
        at, word = starts.copy(), np.arange(len(starts))
        while len(word):
            best, best_end = np.full(len(word), -1), at.copy()
            row, cur, node = np.arange(len(word)), at, np.zeros(len(word), np.int64)
            while len(row):
                step = node * SYMBOLS + symbols[cur]
                k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                go = self.steps[k] == step
                row, cur, node = row[go], cur[go] + 1, self.nodes[k[go]]
                token = self.tokens[node]
                hit = token >= 0
                best[row[hit]], best_end[row[hit]] = token[hit], cur[hit]
                go = cur < ends[word[row]]
                row, cur, node = row[go], cur[go], node[go]
            lost[word[best < 0]] = True
            go = best >= 0
            words.append(word[go])
            tokens.append(best[go])
            go &= best_end < ends[word]
            word, at = word[go], best_end[go]
        owner = np.concatenate(words) if words else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return owner[order], (np.concatenate(tokens)[order] if words else owner), lost

    def propose_one(self, symbols: list[int]) -> list[int]:
        """Greedy longest match of one long word; empty where a symbol is unknown."""
        out, at, n = [], 0, len(symbols)
        while at < n:
            node, cur, best, end = 0, at, -1, at
            while cur < n and (node := self.child.get(node * SYMBOLS + symbols[cur], 0)):
                cur += 1
                if self.token[node] >= 0:
                    best, end = self.token[node], cur
            if best < 0:
                return []
            out.append(best)
            at = end
        return out

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Exact merging of many short words: rows of ids, filled up with -1, to the same after all merges."""
        out = rows.copy()
        here, ids = np.arange(len(rows)), rows
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(rows.shape[1])
        while len(here):
            j = ranks.argmin(axis=1)
            row = np.arange(len(here))
            go = ranks[row, j] < NEVER
            out[here[~go]] = ids[~go]
            here, ids, ranks, j = here[go], ids[go], ranks[go], j[go]
            if not len(here):
                break
            row = row[:len(here)]
            new = self.makes[ranks[row, j]]
            moved = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1)], axis=1)
            ids = np.where(columns <= j[:, None], ids, moved)
            ids[row, j] = new
            moved = np.concatenate([ranks[:, 1:], np.full((len(ids), 1), NEVER)], axis=1)
            ranks = np.where(columns[:-1] <= j[:, None], ranks, moved)
            ranks[row, j] = self.pair_ranks(new, ids[row, np.minimum(j + 1, ids.shape[1] - 1)])
            inner = j > 0
            ranks[row[inner], j[inner] - 1] = self.pair_ranks(ids[row[inner], j[inner] - 1], new[inner])
        return out

    def failing(self, owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Owners of the proposals with a token or a pair of neighbours that fails the test."""
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        return np.concatenate([owner[self.made[tokens] == NEVER], owner[inner[~good[which]]]])

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids (32-bit little-endian) of each non-empty word: proposed, tested pair by pair, merged where the test fails."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self._encode_long(words[i])
        short = np.flatnonzero(lengths <= SHORT)
        if not len(short):
            return out
        lengths = lengths[short]
        symbols = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbols[ends - 1] += self.ends
        owner, tokens, lost = self.propose(symbols, starts, ends)
        lost[self.failing(owner, tokens)] = True
        good = ~lost[owner]
        owners, ids = [owner[good]], [tokens[good]]
        again = np.flatnonzero(lost)
        again = again[np.argsort(lengths[again], kind="stable")]
        for at in range(0, len(again), ROWS):
            some = again[at:at + ROWS]
            columns = np.arange(max(2, lengths[some].max()))
            inside = columns < lengths[some][:, None]
            rows = np.where(inside, self.symbol[symbols[np.where(inside, starts[some][:, None] + columns, 0)]], -1)
            rows = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), axis=1)  # unknown symbols are left out
            rows = self.merge_rows(rows)
            kept = rows >= 0
            owners.append(np.repeat(some, kept.sum(axis=1)))
            ids.append(rows[kept])
        owner, flat = np.concatenate(owners), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        data = flat[order].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(short))))) * 4
        for i, a, b in zip(short.tolist(), upto[:-1].tolist(), upto[1:].tolist()):
            out[i] = data[a:b]
        return out

    def _encode_long(self, word: bytes) -> bytes:
        symbols = list(word)
        symbols[-1] += self.ends
        tokens = np.array(self.propose_one(symbols), np.int64)
        if not len(tokens) or len(self.failing(np.zeros(len(tokens), np.int64), tokens)):
            tokens = np.array(self.merge(symbols), np.int64)
        return tokens.astype("<u4").tobytes()


# The alternatives by which the tokenizer's file cuts words, and its white space, as classes.
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


class Words:
    """Text -> words as the tokenizer's file normalises and cuts it.

    Texts below U+0250 go by a pattern: there letters, digits and lower case are the same in every version of Unicode, and
    no two characters compose. Others go through the tokenizer library's own normaliser and cutter.
    """

    def __init__(self, data: bytes):
        import re
        import unicodedata

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        spec = json.loads(data)
        known = {"normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
                 "pre_tokenizer": [{"type": "Split", "pattern": {"Regex": "|".join(SUFFIXES) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                                   {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        parts = {"normalizer": (spec.get("normalizer") or {}).get("normalizers"), "pre_tokenizer": (spec.get("pre_tokenizer") or {}).get("pretokenizers")}
        self.plain = parts == known  # another file's words are all cut by the library
        self.wide = re.compile("[^\x00-ɏ]")
        self.lower = {i: "".join(c.lower() for c in chr(i)) for i in range(0x250)}
        letters, digits = ("".join({c for x in self.lower.values() for c in x if unicodedata.category(c)[0] == kind}) for kind in "LN")
        self.cut = re.compile("|".join(SUFFIXES) + f"|[{letters}]+|[{digits}]|[^{SPACES}{letters}{digits}]+")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that are normalised or strip their surroundings are not supported")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def pieces(self, text: str) -> list[str]:
        """Alternately words' text and added tokens, as they stand in the text."""
        return self.marks.split(text) if self.marks else [text]

    def of(self, piece: str) -> list[str | bytes]:
        """The words of a piece, as text, or as bytes where the library has cut it."""
        if self.plain and not self.wide.search(piece):
            return self.cut.findall(piece.lower() if piece.isascii() else piece.translate(self.lower))
        if not piece:
            return []
        normal = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
        cutter = self.library.pre_tokenizer
        found = [w for w, _ in cutter.pre_tokenize_str(normal)] if cutter else [normal]
        return [bytes(map(self.byte.__getitem__, w)) for w in found if w]


class Codec:
    """Ids of texts, and their text again as the library writes it without a decoder: tokens joined by spaces."""

    def __init__(self, data: bytes, merges: Merges, remembered: int = REMEMBERED):
        self.words, self.merges, self.limit = Words(data), merges, remembered
        self.ids: dict[str | bytes, bytes] = {}
        self.names = dict(merges.names) | {i: t for t, i in self.words.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        special = self.words.special
        cut = [[special[p] if k % 2 else self.words.of(p) for k, p in enumerate(self.words.pieces(t))] for t in texts]
        if len(self.ids) > self.limit:
            self.ids = {}
        seen: set = set()
        for pieces in cut:
            seen.update(*[p for p in pieces if isinstance(p, list)])
        new = list(seen - self.ids.keys())
        self.ids.update(zip(new, self.merges.encode([w if isinstance(w, bytes) else w.encode() for w in new])))
        look = self.ids.__getitem__
        return [b"".join([b"".join(map(look, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_words(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (32-bit little-endian) and decoded text of every document; see ``word_digests`` for the cases."""
    return _map(docs, path, digests=False)


def word_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of ``docs(doc_id, text)``.

    ``path`` names a tokenizers file of plain BPE without decoder. Added tokens in a text are found before anything else
    and have their own ids; no other special token is added. A null text counts as empty and has no tokens. Repeated rows
    each get a row; other columns are ignored; an empty table gives an empty one. A row is bounded by its document.
    """
    return _map(docs, path, digests=True)


def _map(docs, path, digests):
    data = vocabulary_file(FILE, path)
    spec = json.loads(data)
    if spec.get("decoder") or spec.get("post_processor"):
        raise ValueError("files with a decoder or post-processor are not supported")
    # Derived once, from a file below 2 MB: a few numbers a token.
    shared = docs.sparkSession.sparkContext.broadcast((data, Merges(spec)))

    @per_task
    def make():
        codec = Codec(*shared.value)

        def step(rows):
            ids = codec.encode([t or "" for t in rows["text"]])
            decoded = [codec.decode(x) for x in ids]
            out = {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids]}
            if digests:
                return out | {"ids_sha256": [sha256(x).hexdigest() for x in ids], "decoded_sha256": [sha256(t.encode()).hexdigest() for t in decoded]}
            return out | {"ids": ids, "decoded": decoded}

        return step

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return map_columns(docs.select("doc_id", "text"), make, f"doc_id long, n_tokens long, {kinds}")
