"""BPE encoding and decoding with a transducer lexicon of the frequent words.

The words of the corpus are counted; the most frequent ones are encoded once and compiled into a
minimal acyclic transducer (``lexicon``) that every worker maps into memory.  Other words are
merged exactly.  The lexicon changes the speed only: results equal the tokenizers library's.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm.common import held, map_rows, materialize, most_frequent, table
from gapweave.llm.lexicon import Lexicon, compile_words

#: Words in the lexicon (about 1 MB) and their least count; rarer ones are merged when they come.
LEXICON_WORDS, FREQUENT = 50_000, 8
#: Words that a worker remembers before it starts anew, and the most characters of them.
CACHE_WORDS, CACHE_CHARS = 150_000, 2_000_000
#: Bits of an id where two numbers are packed into one.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 60
#: What the tokenizer's expression engine counts as white space (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"[{L}]+|[{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{S}{L}{N}]+"
#: The first characters on which Unicode versions differ lie here or beyond.
BEYOND = re.compile("[\u0300-\u036f\u0530-\U0010ffff]").search


def ranges(chosen, stop: int) -> str:
    """The characters below ``stop`` for which ``chosen(character)`` holds, as the inside of a class."""
    out, start = [], None
    for c in range(stop + 1):
        inside = c < stop and chosen(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def _plain_words():
    """Finds the words of texts without characters that BEYOND finds."""
    plain = {x for c in map(chr, range(0x530)) if not BEYOND(c) for x in c.lower()}
    kinds = {k: ranges(lambda c: unicodedata.category(c)[0] == k and c in plain, 0x10000) for k in "LN"}
    return re.compile(PATTERN.format(S=SPACE, **kinds)).findall


@functools.cache
def _doubtful():
    """Finds characters that Unicode versions class, order or compose differently: those unassigned in the
    version of ``unicodedata``, and marks and composed characters that came after version 3.2."""

    def differs(c: str) -> bool:
        kind = unicodedata.category(c)
        new = kind != "Cn" and unicodedata.ucd_3_2_0.category(c) == "Cn"
        return kind == "Cn" or (new and (kind[0] == "M" or bool(unicodedata.decomposition(c))))

    return re.compile(f"[{ranges(differs, 0x110000)}]").search


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class WordBPE:
    """The tokenizer of one file: byte-level BPE with word ends, lower case, white space dropped."""

    def __init__(self, definition: str):
        import regex

        self.definition = definition
        d = json.loads(definition)
        model = d["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or d["decoder"] is not None:
            raise ValueError("this encoder reads BPE files with </w> word ends and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Both ids of a pair in one number, to its rank and the id of what it becomes.
        self.pairs = {self.vocab[a] << ID_BITS | self.vocab[b]: i << ID_BITS | self.vocab[a + b] for i, (a, b) in enumerate(merges)}
        self.byte_id = [self.vocab[c] for c in byte_alphabet()]
        self.last_id = [self.vocab[c + "</w>"] for c in byte_alphabet()]
        self.any_words = regex.compile(PATTERN.format(S=SPACE, L=r"\p{L}", N=r"\p{N}")).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_str(self.definition)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised.  A text with doubtful characters is normalised
        and split with the library's own tables."""
        if not BEYOND(text):
            return _plain_words()(self.normalize(text))
        if not _doubtful()(text):
            return self.any_words(self.normalize(text))
        normalized = self.library.normalizer.normalize_str(text)
        return [normalized[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normalized)]

    def merge(self, word: str) -> list[int]:
        """The ids of one word: always the pair of the lowest rank, leftmost first."""
        data = word.encode()
        ids = [*map(self.byte_id.__getitem__, data[:-1]), self.last_id[data[-1]]]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.pairs.get
        best = [get(a << ID_BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while best and (least := min(best)) != NO_MERGE:
            i = best.index(least)
            new = ids[i] = least & ID_MASK
            del ids[i + 1], best[i]
            if i:
                best[i - 1] = get(ids[i - 1] << ID_BITS | new, NO_MERGE)
            if i < len(best):
                best[i] = get(new << ID_BITS | ids[i + 1], NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, in n log n steps; a merged-away place holds -1."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << ID_BITS | ids[j]) != m:
                continue
            ids[i], ids[j] = m & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get(ids[i] << ID_BITS | ids[after[i]])) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := get(ids[before[i]] << ID_BITS | ids[i])) is not None:
                heapq.heappush(heap, (m, before[i]))
        return [i for i in ids if i >= 0]

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a final sigma is no special case there

    def pieces(self, text: str):
        """(is special, piece) in order."""
        if self.split_special is None or "<" not in text:
            yield False, text
            return
        for p in self.split_special(text):
            yield p in self.special, p


class Encoder:
    """Encodes with a lexicon.  The ids of words are remembered, as little-endian words of 32 bits; for new words
    the transducer is asked, all those of some texts in step, and what it lacks is merged."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon | None):
        self.bpe, self.lexicon, self.known, self.chars = bpe, lexicon, {}, 0
        self.token = [bpe.token.get(i, "") for i in range(max(bpe.token) + 1)]

    def learn(self, words: list[str]) -> None:
        found = self.lexicon.get_many(words) if self.lexicon else [None] * len(words)
        for w, ids in zip(words, found, strict=True):
            if ids is None:
                ids = array.array("I", self.bpe.merge(w)).tobytes()
            self.known[w] = ids
            self.chars += len(w)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text; a null text counts as empty."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        pieces = [[(special, p if special else self.bpe.words(p)) for special, p in self.bpe.pieces(t or "")] for t in texts]
        new = {w for ps in pieces for special, ws in ps if not special for w in ws if w not in self.known}
        self.learn(sorted(new))
        out = []
        for ps in pieces:
            ids = b"".join([struct.pack("<I", self.bpe.special[x]) if special else b"".join(map(self.known.__getitem__, x)) for special, x in ps])
            out.append((ids, " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))))
        return out


def decode(bpe: WordBPE, ids) -> str:
    """The tokens of ids joined by one space, as the library decodes files without a decoder."""
    return " ".join(bpe.token[i] for i in ids if i in bpe.token)


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent letter runs of count FREQUENT or more over the whole corpus, at most n.  Counts are summed per task
    before they are shuffled, so a word with a third of all occurrences is a row per task."""
    w = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w != ''")
    counts = materialize(w.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT), "word-counts")
    return sorted(r.w for r in most_frequent(counts, "w", "c", n).collect())


def tokenizer_definition(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def ship_lexicon(spark: SparkSession, bpe: WordBPE, words: list[str]) -> str:
    """Compiles the lexicon and gives every worker a copy of the file; the name to find it by."""
    known = {w for x in words for w in bpe.words(x)}
    name = f"gapweave-{uuid.uuid4().hex}.lex"
    folder = tempfile.mkdtemp(prefix="gapweave-lex-")
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(compile_words({w: bpe.merge(w) for w in known}))
    spark.sparkContext.addFile(path)
    return name


def encode_rows(docs: DataFrame, row, schema: str, path: str | None = None) -> DataFrame:
    """``row(doc_id, ids, decoded)`` for each document."""
    spark = docs.sparkSession
    definition = tokenizer_definition(path)
    name = ship_lexicon(spark, WordBPE(definition), frequent_words(docs))
    shipped = spark.sparkContext.broadcast(definition)

    def build():
        from pyspark import SparkFiles

        return Encoder(WordBPE(shipped.value), Lexicon(SparkFiles.get(name)))

    def rows(batch):
        encoder = held(name, build)
        found = encoder.encode_all([text for _, text in batch])
        return [row(doc_id, *x) for (doc_id, _), x in zip(batch, found, strict=True)]

    return map_rows(docs.select("doc_id", "text"), rows, schema, name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: a row for each row, none is moved.  Null and empty
    texts have no ids and decode to the empty text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode_rows(docs, lambda d, ids, text: (d, list(struct.unpack(f"<{len(ids) // 4}I", ids)), text), f"doc_id {kind}, ids array<int>, decoded string", path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each row, repeated ones too.  Null and empty
    texts have no tokens; only ``doc_id`` and ``text`` are read, whatever other columns there are."""

    def row(doc_id, ids, decoded):
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode_rows(docs, row, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
