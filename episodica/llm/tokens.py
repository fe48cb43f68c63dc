"""Exact token ids and counts of whole texts by way of their chunks, and of every prefix by dynamic programming.

The vocabulary's pre-tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks (runs without ASCII
white space) one after the other. For ids, each distinct chunk of some megabytes of texts is encoded once. For counts nothing is encoded:
PrefixCounter finds those at each code point of a chunk, and a text's counts at chunk ends are the running sums of its chunks' last ones.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.common import ship_package, tidy

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text taken at once: by a coder (more texts share more chunks), and by those who keep texts as Python objects.
CODED_BYTES, SLICE_BYTES = 6_000_000, 2_000_000
#: Marks that make a piece of their own after letters.
MARKS = ".,"
#: A word of Latin letters and a mark. Left out is the dotted capital I, which in lower case ends in an accent that joins the mark.
MARKED = "^[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+[.,]$"
#: Words joined for one call of the library.
JOINED = 1000
#: The contractions that the pre-tokenizer splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
CHUNK, WORD = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
#: Latin letters and signs without the dotted capital I: alike in all versions of Unicode, normalized, and one code point each in lower case.
COMMON = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]+\\Z")
#: Pairs of tokens that a worker remembers.
MOST_PAIRS = 2_000_000
#: Bytes of pieces with their counts, PIECE_COST each besides its own, and of chunks that a worker remembers; a slice of texts may pass them.
MOST_PIECE_BYTES, PIECE_COST, MOST_CHUNK_BYTES = 80_000_000, 200, 16_000_000


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Coded:
    """Texts as numbers of distinct chunks: index holds those of all texts one after the other, n how many each text has.

    Chunk k has the ids ids[starts[k] : starts[k] + lens[k]]. Number blank, if any, is the empty string, which splitting leaves at a text's
    ends and which has no ids.
    """

    index: np.ndarray
    n: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    blank: int

    def all_ids(self) -> np.ndarray:
        return gathered(self.ids, self.starts[self.index], self.lens[self.index])


def gathered(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The runs of ids one after the other, each followed by one of then."""
    if then is None:
        at = np.repeat((starts - (np.cumsum(lens) - lens)).astype(np.int32), lens)  # a slice has fewer than 2 ** 31 ids
        at += np.arange(len(at), dtype=np.int32)
        return ids[at]
    after = np.cumsum(lens + 1) - 1
    out = np.empty(int(lens.sum()) + len(lens), ids.dtype)
    own = np.ones(len(out), bool)
    own[after] = False
    out[own] = gathered(ids, starts, lens)
    out[after] = then
    return out


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The chunks of texts as numbers of distinct ones, how many each text has, and the distinct ones, in ASCII lower case."""
    lowered = pc.ascii_lower(texts)
    # accents, which lower-casing first might join to a letter, and special strings, which the library looks for in the text as it is
    as_is = pc.match_substring_regex(texts, "[\u0300-\u036f]|<\\|")
    if pc.any(as_is).as_py():
        lowered = pc.if_else(as_is, texts, lowered)
    lists = pc.ascii_split_whitespace(lowered)
    chunks = lists.flatten().dictionary_encode()
    return chunks.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), chunks.dictionary


class Remembered:
    """Chunks that a worker has seen, in one array, which new ones are looked up in at once."""

    def __init__(self) -> None:
        self.known = pa.array([], pa.large_string())

    def places(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array, bool]:
        """Where each chunk will stand, those that are new, and whether what was known is forgotten first: when it takes more than MOST_CHUNK_BYTES."""
        distinct = distinct.cast(pa.large_string())
        fresh = self.known.nbytes > MOST_CHUNK_BYTES
        if fresh:
            self.known = pa.array([], pa.large_string())
        at = pc.index_in(distinct, value_set=self.known)
        is_new = at.is_null()
        new = distinct.filter(is_new)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[is_new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        return place, new, fresh


class ChunkCoder:
    """Ids of texts by way of the library's ids of their distinct chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.plain = Tokenizer.from_file(path)  # for lower-case ASCII letters, which need no normalizer and no pattern
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: vocab[f"{m}</w>"] for m in MARKS}
        self.path = path
        self.seen = Remembered()
        self.ids, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def prefixes(self) -> PrefixCounter:
        return prefix_counter(self.path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode(chunks)
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _words(self, words: list[str], library) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words of letters alone: each is one piece, which ends in the only token of it that ends a word."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            got = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            own = (got, np.diff(last, prepend=-1)) if len(last) == len(part) else self._single(part)
            ids.append(own[0])
            lens.append(own[1])
        return np.concatenate(ids), np.concatenate(lens)

    def code(self, texts: pa.Array) -> Coded:
        """texts: strings without null."""
        index, n, distinct = chunked(texts)
        place, new, fresh = self.seen.places(distinct)
        if fresh:
            self.ids, self.starts, self.lens = self.ids[:0], self.starts[:0], self.lens[:0]
        ids, starts, lens = self.encoded(new)
        self.starts, self.lens = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids])
        return Coded(index, n, self.ids, self.starts[place], self.lens[place], pc.index(distinct, "").as_py())

    def encoded(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and where in them each chunk's begin and how many they are."""
        alone = pc.utf8_is_alpha(distinct).to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(distinct, MARKED).to_numpy(zero_copy_only=False)
        odd = ~alone & ~marked
        take = lambda mask: distinct.filter(pa.array(mask))
        words = pa.concat_arrays([take(alone), pc.utf8_slice_codeunits(take(marked), 0, -1)]).dictionary_encode()
        easy = pc.match_substring_regex(words.dictionary, "^[a-z]+$").to_numpy(zero_copy_only=False)
        parts = [self._words(words.dictionary.filter(pa.array(easy)).to_pylist(), self.plain), self._words(words.dictionary.filter(pa.array(~easy)).to_pylist(), self.library)]
        ids, lens = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(lens) - lens
        place = np.empty(len(easy), np.int64)
        place[np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])] = np.arange(len(easy))
        of = place[words.indices.to_numpy(zero_copy_only=False)]

        n_alone = int(alone.sum())
        base = of[n_alone:]
        then = np.array([self.marks[c] for c in pc.utf8_slice_codeunits(take(marked), -1).to_pylist()], np.uint32)
        ids_m, lens_m = gathered(ids, starts[base], lens[base], then), lens[base] + 1
        ids_o, lens_o = self._single(take(odd).to_pylist())
        out_starts, out_lens = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        out_starts[alone], out_lens[alone] = starts[of[:n_alone]], lens[of[:n_alone]]
        out_starts[marked], out_lens[marked] = len(ids) + np.cumsum(lens_m) - lens_m, lens_m
        out_starts[odd], out_lens[odd] = len(ids) + len(ids_m) + np.cumsum(lens_o) - lens_o, lens_o
        return np.concatenate([ids, ids_m, ids_o]), out_starts, out_lens


class PrefixCounter:
    """Token counts of all prefixes of a chunk: the last token of a prefix is the one whose neighbour on its left accepts it.

    A sequence of tokens is what the merges make of its text exactly if that holds for each two neighbours, so the count of a prefix is one
    more than the count of what stands before its last token. The last symbol before a piece's end is a symbol of its own (word end), so
    each prefix has two counts: as the inside of a piece, and as all of it. The counts of a piece are kept at each of its code points.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in model["added_tokens"]]
        model = model["model"]
        self.end = model["end_of_word_suffix"]
        self.trie: dict = {}  # of the tokens' symbols from the last to the first; nodes where one begins say of which kind it is
        for t in model["vocab"]:
            node, kind = self.trie, "final" if t.endswith(self.end) else "inner"
            for c in reversed(t.removesuffix(self.end)):
                node = node.setdefault(c, {})
            node[kind] = True
        tokens, last_ones = ({t.removesuffix(self.end) for t in model["vocab"] if t.endswith(self.end) == k} for k in (False, True))
        self.ending = ahocorasick.Automaton()
        for t in tokens | last_ones:
            self.ending.add_word(t, (len(t), t if t in tokens else "", t + self.end if t in last_ones else ""))
        self.ending.make_automaton()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.made = {"".join(m): (i, *m) for i, m in enumerate(merges)}  # rank and parts of a token that is not a single symbol
        self.piece = regex.compile("|".join(CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.kinds = {k: regex.compile(p) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), (" ", r"\p{White_Space}"))}
        self.letter = _byte_letters()
        self.memo, self.memo_bytes = {}, 0
        self.seen, self.seen_totals = Remembered(), np.zeros(0, np.int64)
        self._sound: dict[str, bool] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._kind: dict[str, str] = {}
        self._settled: dict[str, bool] = {}
        self._joins: set[str] = set()
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)  # for its tables of code points, which may be of another version of Unicode
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer

    def sound(self, token: str) -> bool:
        """Whether the merges make this token of its own symbols."""
        found = self._sound.get(token)
        if found is None:
            parts = (*token[: -len(self.end)][:-1], token[: -len(self.end)][-1] + self.end) if token.endswith(self.end) else tuple(token)
            out = list(parts)
            while len(out) > 1:
                best = min(range(len(out) - 1), key=lambda i: self.ranks.get((out[i], out[i + 1]), 1 << 60))
                if (out[best], out[best + 1]) not in self.ranks:
                    break
                out[best : best + 2] = [out[best] + out[best + 1]]
            found = self._sound[token] = out == [token]
        return found

    def fits(self, a: str, b: str) -> bool:
        """Whether no merge ever joins a's right edge with b's left edge. a may be empty: the piece's start.

        Going back from the finished tokens, the one that was made last is taken apart; a merge of the two edges that then stood side by side
        would have come first if its rank is lower than that of what was undone (or the same, and further left).
        """
        found = self._fits.get((a, b))
        if found is None:
            found = self.sound(b)
            x, y, limit = a, b, 1 << 60
            while found and a:
                if self.ranks.get((x, y), 1 << 60) < limit:
                    found = False
                    break
                of_x, of_y = self.made.get(x), self.made.get(y)
                if of_x is None and of_y is None:
                    break
                if of_y is None or (of_x is not None and of_x[0] > of_y[0]):
                    limit, x = of_x[0], of_x[2]
                else:
                    limit, y = of_y[0] + 1, of_y[1]
            if len(self._fits) > MOST_PAIRS:
                self._fits.clear()
            self._fits[a, b] = found
        return found

    def grow(self, symbols: Sequence[str], last: list[str], inner: list[int], final: list[int]) -> None:
        """One more symbol, the i-th, of a piece: appends its last inner token and the counts of both kinds. Tokens are looked up from their ends."""
        i, known, node = len(last), self._fits, self.trie
        inside, ending, j = [], [], i
        while j:
            j -= 1
            node = node.get(symbols[j])
            if node is None:
                break
            if "inner" in node:
                inside.append(j)
            if "final" in node:
                ending.append(j)
        for tokens, counts, tail in ((inside, inner, ""), (ending, final, self.end)):
            for j in reversed(tokens):  # the longest first
                t = "".join(symbols[j:i]) + tail
                ok = known.get((last[j], t))
                if ok or (ok is None and self.fits(last[j], t)):
                    break
            else:
                raise ValueError("no token ends here")
            if tail:
                counts.append(inner[j] + 1)
            else:
                step, token = inner[j] + 1, t
        inner.append(step)
        last.append(token)

    def learn(self, pieces: Iterable[str]) -> None:
        """Counts of pieces that the pre-tokenizer keeps whole, into the memo. In sorted order a piece goes on from what it shares with the one before."""
        last, inner, final, before, known = [""], [0], [0], "", self._fits
        for piece in sorted(set(pieces)):
            ascii_ = piece.isascii() and piece.isprintable()  # each byte stands for itself
            s = piece if ascii_ else "".join(map(self.letter.__getitem__, piece.encode()))
            shared = 0
            for x, y in zip(s, before):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], inner[shared + 1 :], final[shared + 1 :]
            for e, (n, t, u) in self.ending.iter(s):  # tokens by their ends, the longest first
                if e < shared:
                    continue
                j = e + 1 - n
                if t and len(last) == e + 1:
                    ok = known.get((last[j], t))
                    if ok or (ok is None and self.fits(last[j], t)):
                        last.append(t)
                        inner.append(inner[j] + 1)
                if u and len(final) == e + 1:
                    ok = known.get((last[j], u))
                    if ok or (ok is None and self.fits(last[j], u)):
                        final.append(inner[j] + 1)
            if not len(last) == len(final) == len(s) + 1:
                raise ValueError("no token ends here")
            before = s
            if ascii_:
                self.memo[piece] = array("I", final[1:])
                self.memo_bytes += PIECE_COST + 5 * len(piece)
            else:
                ends, at = [], 0
                for c in piece:
                    at += len(c.encode())
                    ends.append(final[at])
                self.memo[piece] = array("I", ends)
                self.memo_bytes += PIECE_COST + 8 * len(piece)

    def forget(self) -> bool:
        """Forgets the pieces if they take more than MOST_PIECE_BYTES, and says whether it did."""
        if self.memo_bytes <= MOST_PIECE_BYTES:
            return False
        self.memo, self.memo_bytes = {}, 0
        return True

    def of_pieces(self, pieces: list[str]) -> list[array]:
        missing = [p for p in pieces if p not in self.memo]
        if missing:
            if self.forget():
                missing = pieces
            self.learn(missing)
        return [self.memo[p] for p in pieces]

    def plain(self, chunk: str) -> str | None:
        """The chunk as the normalizer leaves it, if each of its prefixes is a prefix of that, one code point for each."""
        if "<|" in chunk:
            return None
        if chunk.isascii() or COMMON.match(chunk):
            return chunk.lower()
        if not unicodedata.is_normalized("NFC", chunk):
            return None
        out = []
        for c in chunk:
            if not self.settled(c):
                return None
            out.append(c.lower())  # one by one: what a final sigma becomes is no concern of the normalizer
        return "".join(out)

    def settled(self, c: str) -> bool:
        """Whether a code point is one in lower case, and this Python and the library take it for the same."""
        found = self._settled.get(c)
        if found is None:
            low = c.lower()
            found = len(low) == 1 and (low == self.lowered(c) or c.isspace()) and self.kind(low) == next((k for k, p in self.kinds.items() if p.match(low)), "O")
            self._settled[c] = found
        return found

    def lowered(self, s: str) -> str:
        return self.normalizer.normalize_str(s)

    def kind(self, c: str) -> str:
        """Letter, number, white space or other, as the library's pre-tokenizer has it."""
        found = self._kind.get(c)
        if found is None:
            if c.isascii():
                found = next((k for k, p in self.kinds.items() if p.match(c)), "O")
            else:
                split = lambda s: len(self.splitter.pre_tokenize_str(s))
                found = "L" if split("a" + c) == 1 and split(c) == 1 and split("!" + c) == 2 else "O" if split("!" + c) == 1 and split(c) == 1 else "N" if split(c) == 1 else " "
            self._kind[c] = found
        return found

    def totals(self, chunks: list[str]) -> np.ndarray:
        """The last count of each chunk; an empty one has none."""
        out = np.zeros(len(chunks), np.int64)
        pieces: list[list[str] | None] = []
        for c in chunks:
            if c.isalpha() and COMMON.match(c):
                pieces.append([c.lower()])
            else:
                s = self.plain(c)
                pieces.append(None if s is None else self.piece.findall(s))
        self.forget()
        self.learn(p for own in pieces if own for p in own if p not in self.memo)
        for k, own in enumerate(pieces):
            out[k] = (self._walk(chunks[k], every=False)[-1] if own is None else sum(self.memo[p][-1] for p in own)) if chunks[k] else 0
        return out

    def remembered_totals(self, distinct: pa.Array) -> np.ndarray:
        """As totals; chunks seen before are looked up."""
        place, new, fresh = self.seen.places(distinct)
        known = self.seen_totals[:0] if fresh else self.seen_totals
        self.seen_totals = np.concatenate([known, self.totals(new.to_pylist())])
        return self.seen_totals[place]

    def of_chunk(self, chunk: str) -> list[int]:
        """Counts of the first 1, 2, ... code points of a chunk."""
        s = self.plain(chunk)
        if s is None:
            return self._walk(chunk)
        out: list[int] = []
        at, so_far = 0, 0
        found = list(self.piece.finditer(s))
        counts = self.of_pieces([m.group() for m in found])
        for m, own in zip(found, counts, strict=True):
            out += [so_far] * (m.start() - at)  # white space that is not ASCII's
            p = m.group()
            if p in CONTRACTIONS:  # a part of it is a mark and letters
                parts = ["'", *(p[1 : i + 1] for i in range(1, len(p) - 1))]
                heads = self.of_pieces(parts)
                quote = heads[0][-1]
                out += [so_far + quote, *(so_far + quote + h[-1] for h in heads[1:]), so_far + own[-1]]
            else:
                out += [so_far + n for n in own]
            at, so_far = m.end(), so_far + own[-1]
        return out + [so_far] * (len(s) - at)

    def joins(self, c: str) -> bool:
        """Whether normalization may join or reorder a code point with what stands before it."""
        if not self._joins:
            pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0xC0, 0x1F000) if not 0xAC00 <= i < 0xD7A4)
            self._joins = {chr(int(d[1], 16)) for d in pairs if len(d) == 2 and not d[0].startswith("<")}
            self._joins |= {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
            self._joins |= {"\U000110BA", "\U00011127", "\U0001133E", "\U00011357", "\U000114B0", "\U000114BA", "\U000114BD", "\U000115AF", "\U00011930"}
        return unicodedata.combining(c) != 0 or c in self._joins

    def _walk(self, chunk: str, every: bool = True) -> list[int]:
        """As of_chunk, for any chunk, or without every its last count alone: special strings are looked for in the text as it is, what stands
        between them is normalized by itself, and a group of code points that normalization joins grows within the run."""
        out: list[int] = []
        done, at = 0, 0  # tokens and code points up to the last special string
        while at <= len(chunk):
            hits = [(i, t) for t in self.special if (i := chunk.find(t, at)) >= 0]
            stop, token = min(hits, key=lambda h: (h[0], -len(h[1]))) if hits else (len(chunk), "")
            run, k = _Run(self), at
            while k < stop:
                e = k + 1
                while e < stop and self.joins(chunk[e]):
                    e += 1
                if every and e > k + 1:
                    out += [done + n for n in self._group(run, chunk[k:e])]
                else:
                    run.push_all(chunk[k:e])
                    out.append(done + run.count())
                k = e
            if not token:
                break
            for part in range(1, len(token) if every else 1):
                mark = run.mark()
                run.push_all(token[:part])
                out.append(done + run.count())
                run.back(mark)
            done += run.count() + 1
            out.append(done)
            at = stop + len(token)
        return out

    def _group(self, run: _Run, group: str) -> list[int]:
        """Counts at each code point of a group, which the run then has taken up whole. A mark that comes after one of its own class stays where it
        is, and nothing before it changes: it is added. For any other what has come since the last letter that stands by itself is normalized
        anew; what changes is taken back and added. So only marks of falling classes by turns cost more than their number."""
        out, known, marks = [], [], []  # the group so far as normalized, and the run before each of its code points
        since, at = 0, 0  # where that letter is in the group, and in known
        for part, c in enumerate(group, 1):
            own, tail = unicodedata.combining(c), self.lowered(c)
            if not (own and known and all(unicodedata.combining(x) == unicodedata.combining(known[-1]) == own for x in tail)):
                now, before = self.lowered(group[since:part]), known[at:]
                keep = next((i for i, (x, y) in enumerate(zip(now, before)) if x != y), min(len(now), len(before)))  # noqa: B905
                if keep == len(before) and not own:
                    since, at = part - 1, len(known)
                elif keep < len(before):
                    run.back(marks[len(known) - len(before) + keep])
                    del marks[len(known) - len(before) + keep :], known[len(known) - len(before) + keep :]
                tail = now[keep:]
            for x in tail:
                marks.append(run.mark())
                run.push(x)
                known.append(x)
            out.append(run.count())
        return out


class _Run:
    """The pieces of a text that grows by code points, with the counts of the piece at its end; mark() and back() take growth back."""

    def __init__(self, counter: PrefixCounter):
        self.c, self.before, self.kind, self.text, self.held = counter, 0, "", "", 0
        self.symbols, self.last, self.inner, self.final = [], [""], [0], [0]

    def count(self) -> int:
        return self.before + self.final[-1]

    def mark(self) -> tuple:
        return self.before, self.kind, self.text, self.held, self.symbols, self.last, self.inner, self.final, len(self.last)

    def back(self, m: tuple) -> None:
        self.before, self.kind, self.text, self.held, self.symbols, self.last, self.inner, self.final, n = m
        del self.symbols[n - 1 :], self.last[n:], self.inner[n:], self.final[n:]

    def push_all(self, raw: str) -> None:
        for c in self.c.lowered(raw):
            self.push(c)

    def _start(self, kind: str) -> None:
        self.before, self.kind, self.text = self.count(), kind, ""
        self.symbols, self.last, self.inner, self.final = [], [""], [0], [0]

    def push(self, c: str) -> None:
        kind, text = self.c.kind(c), self.text
        # text: a quote that begins a piece and the letters after it, as long as they may become a contraction
        if text and text + c in CONTRACTIONS:
            self._start("")
            self.before = self.held + self.c.of_pieces([text + c])[0][-1]
            return
        may_be = bool(text) and any(x.startswith(text + c) for x in CONTRACTIONS)
        if kind != self.kind or kind in "N ":
            begins_quote = c == "'"
            held = self.count() if begins_quote else self.held
            self._start(kind)
            self.held = held
            self.text = "'" if begins_quote else text + c if may_be else ""
        else:
            self.text = text + c if may_be else ""
        if kind != " ":
            for b in c.encode():
                self.symbols.append(self.c.letter[b])
                self.c.grow(self.symbols, self.last, self.inner, self.final)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CODERS: dict[str, ChunkCoder] = {}


def coder(vocabulary: str) -> ChunkCoder:
    """The worker's coder, kept between tasks."""
    path = vocabulary_path(vocabulary)
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counter(vocabulary: str) -> PrefixCounter:
    """The worker's counter, kept between tasks."""
    path = vocabulary_path(vocabulary)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about most bytes of text: the first row's number and the texts as bytes, null as empty."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        b = t.as_py() or b""
        part.append(b)
        size += len(b)
        if size >= most:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def text_slices(texts: pa.Array, most: int = CODED_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about most bytes of text: the first row's number and the texts, null as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    to, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(to, (to[first - 1] if first else 0) + most, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def fit(c: PrefixCounter, text: str, ends: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix with at most budget tokens, by the prefix counts at chunk ends and those inside one chunk."""
    j, raw = int(np.searchsorted(ends, budget, side="right")), text.encode()  # chunks before j fit whole
    if j == len(ends):
        return len(raw)
    m = next(islice(CHUNK.finditer(raw), j, None))
    left = budget - (int(ends[j - 1]) if j else 0)
    chunk = m.group().decode()
    fits = np.flatnonzero(np.array(c.of_chunk(chunk)) <= left)
    return m.start() + len(chunk[: fits[-1] + 1].encode()) if len(fits) else m.start()


def count_tokens(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fit_bytes (the longest prefix of at most limit tokens) of every row.

    A text's count is the last of its prefix counts, which go on from chunk to chunk; none is encoded. A null or empty text has no bytes and
    no tokens. Rows are kept as they are, with repeated and null ids; other columns are ignored. No shuffle; a worker holds about CODED_BYTES
    of text at once, and one text however long.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fit_bytes", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = prefix_counter(vocabulary)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                index, n, distinct = chunked(texts)
                totals = c.remembered_totals(distinct)
                running = np.concatenate([[0], np.cumsum(totals[index])])  # prefix counts at chunk ends, over all texts of the slice
                to = np.cumsum(n)
                counts = running[to] - running[to - n]
                bytes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                fits = bytes_.copy()
                blank = pc.index(distinct, "").as_py()
                for i in np.flatnonzero(counts > limit):
                    own = index[to[i] - n[i] : to[i]]
                    fits[i] = fit(c, texts[i].as_py(), np.cumsum(totals[own[own != blank]]), limit)
                cols = [batch.column(0).slice(first, len(texts)), pa.array(bytes_), pa.array(counts), pa.array(counts > limit), pa.array(fits)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and counts: the tokens of the first 0, 1, 2, ... code points of the text, as encoding each would give them.

    Answers questions on budgets and truncation by a look or a search. A null or empty text has the one count 0.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = prefix_counter(vocabulary)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                tables = [text_counts(c, t) for t in texts.to_pylist()]
                ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
                cols = [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def text_counts(c: PrefixCounter, text: str) -> np.ndarray:
    """Counts of the first 0, 1, 2, ... code points of a text."""
    out, known = np.zeros(len(text) + 1, np.int32), {}
    so_far, at = 0, 0
    for m in WORD.finditer(text):
        own = known.get(m.group())
        if own is None:
            own = known[m.group()] = np.array(c.of_chunk(m.group()), np.int32)
        out[at + 1 : m.start() + 1] = so_far
        out[m.start() + 1 : m.end() + 1] = own + so_far
        so_far, at = so_far + int(own[-1]), m.end()
    out[at + 1 :] = so_far
    return out
