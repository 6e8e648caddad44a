"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Texts are cut by the pre-tokenizer's pattern. Words that are not a token
themselves become token-position rows, one per byte. A recursive query joins
neighbouring rows to the merge table and contracts, in each word that still has
a pair, the leftmost pair of least rank, until no word has one; ordered
aggregation gives the ids. Decoding joins the ids of whole documents to the
vocabulary and puts the bytes together by ordered aggregation.

A worker keeps the words that it has met, up to a bound; beyond that the older
half is forgotten and encoded anew when it comes again.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, table

#: Words that a worker keeps: about 250 bytes each.
CACHE_WORDS = 1_000_000
#: The same where other work has filled the executors before.
SMALL_CACHE = 200_000
#: Documents that are decoded at a time.
DECODE_ROWS = 64
#: Characters of text that are cut into words at a time, and words in one recursive query.
RUN_CHARS, QUERY_WORDS = 4_000_000, 100_000

# One contraction per word and round. A pair's rank is the id of its union; rank
# and position share a number, so that min() finds the leftmost pair of least rank.
_ENCODE = """
WITH RECURSIVE tokens(word, pos, id, live) AS (
  SELECT word, pos, id, TRUE FROM bytes
  UNION ALL
  SELECT rows_.word, rows_.pos,
         CASE WHEN rows_.pos = best.pair & 4294967295 THEN (best.pair >> 32)::INTEGER ELSE rows_.id END,
         best.pair IS NOT NULL
  FROM (SELECT word, pos, id, lag(pos) OVER (PARTITION BY word ORDER BY pos) AS before FROM tokens WHERE live) rows_
  JOIN (SELECT a.word, min((merges.id::BIGINT << 32) + a.pos) AS pair
        FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next FROM tokens WHERE live) a
        LEFT JOIN merges ON a.id = merges.first AND a.next = merges.second
        GROUP BY a.word) best ON rows_.word = best.word
  WHERE best.pair IS NULL OR rows_.before IS NULL OR rows_.before <> best.pair & 4294967295
)
SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids FROM tokens WHERE NOT live GROUP BY word
"""

# The same for long words, with many contractions a round. Two rules find pairs that
# contracting one at a time would contract just so:
# - a pair of less rank than all others within ``reach`` bytes. What lower ranks do
#   further away comes nearer only by one token that grows, and no token of a lower rank
#   is longer than a third of ``reach``; so neither disturbs the other.
# - in order of rank, the pairs before the first that a contraction could bring forth
#   ("bound"). Of those that overlap, the lower rank goes, and in a run of equal ranks
#   every second one from the left.
_ENCODE_LONG = """
WITH RECURSIVE tokens(word, pos, id, round) AS (
  SELECT word, pos, id, 0 FROM bytes
  UNION ALL
  SELECT word, pos, CASE WHEN goes THEN pair ELSE id END, round + 1
  FROM (SELECT *, lag(goes) OVER (PARTITION BY word ORDER BY pos) AS taken
        FROM (SELECT *, pair IS NOT NULL AND (nearby = pair::BIGINT << 32 | pos
                        OR pair < coalesce(bound, 2147483647) AND free AND (place - start) % 2 = 0 AND coalesce(after >= pair, TRUE)) AS goes
              FROM (SELECT *, last_value(CASE WHEN pair IS DISTINCT FROM before THEN coalesce(before > pair, TRUE) END IGNORE NULLS) OVER w AS free,
                           max(CASE WHEN pair IS DISTINCT FROM before THEN place END) OVER w AS start
                    FROM (SELECT *, lag(pair) OVER w AS before, lead(pair) OVER w AS after, row_number() OVER w AS place,
                                 min(pair) OVER (PARTITION BY word) AS best,
                                 min(least) OVER (PARTITION BY word ORDER BY pair, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound,
                                 min(pair::BIGINT << 32 | pos) OVER (PARTITION BY word ORDER BY pos
                                     RANGE BETWEEN coalesce(reach, 0) PRECEDING AND coalesce(reach, 0) FOLLOWING) AS nearby
                          FROM (SELECT a.*, merges.id AS pair, merges.least, merges.reach
                                FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next FROM tokens WHERE round < ?) a
                                LEFT JOIN merges ON a.id = merges.first AND a.next = merges.second)
                          WINDOW w AS (PARTITION BY word ORDER BY pos))
                    WHERE best IS NOT NULL
                    WINDOW w AS (PARTITION BY word ORDER BY pos))))
  WHERE taken IS NOT TRUE
)
SELECT word, pos, id, round FROM tokens QUALIFY round = max(round) OVER (PARTITION BY word)
"""
_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text, count(*) = count(piece) AS known FROM tokens_ LEFT JOIN vocabulary USING (id) GROUP BY doc"
#: Bytes from which a word counts as long.
LONG = 100
#: Token rows that the rounds of one query for long words may come to, and tokens decoded by one query.
ROUND_ROWS, DECODE_TOKENS = 4_000_000, 500_000
#: What a worker's database may hold, and while it has long words.
MEMORY, LONG_MEMORY = "256MB", "768MB"


def read_ranks(path: str | None) -> dict[bytes, int]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes words by the ranks in a file; ``pattern`` cuts texts into words."""

    def __init__(self, path: str | None = None, pattern: str | None = None, cache_words: int = CACHE_WORDS):
        import duckdb
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.ranks = read_ranks(path)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.cache_words = cache_words
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{MEMORY}'")
        self.db.execute("SET temp_directory = ''")  # what a query holds is bounded, so nothing is spilled to a local folder
        least: dict[int, int] = {}  # the lowest rank of a pair that a token takes part in
        for a, b, i in pairs:
            least[a], least[b] = min(i, least.get(a, i)), min(i, least.get(b, i))
        longest, top = {}, 0  # bytes of the longest token of this or a lower rank
        for t, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            longest[i] = top = max(top, len(t))
        kinds = pa.int32()
        columns = {n: pa.array([p[k] for p in pairs], kinds) for k, n in enumerate(("first", "second", "id"))}
        self._table("merges", columns | {"least": pa.array([least.get(i, 2**31 - 1) for _, _, i in pairs], kinds), "reach": pa.array([3 * longest[i] for _, _, i in pairs], pa.int64())})
        # a piece has one character for each byte
        self._table("vocabulary", {"id": pa.array(list(self.ranks.values()), kinds), "piece": [t.decode("latin-1") for t in self.ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        n = np.array([len(x) for x in raw])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = np.array(self.first, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        rows = {"word": np.repeat(np.arange(len(raw), dtype=np.int32), n), "pos": at, "id": ids}
        if n.max() >= LONG:
            self._contract_long(words, rows)
            return
        self._table("bytes", rows)
        out = self.db.sql(_ENCODE).to_arrow_table()
        for k, encoded in zip(out["word"].to_pylist(), out["ids"].to_pylist()):
            self.known[words[k]] = encoded

    def _contract_long(self, words: list[str], rows: dict) -> None:
        """Words in some rounds of recursion at a time, so that the rows of all rounds stay bounded, until none has a pair."""
        self.db.execute(f"SET memory_limit = '{LONG_MEMORY}'")
        while len(rows["word"]):
            self._table("bytes", rows)
            most = max(2, ROUND_ROWS // len(rows["word"]))
            out = self.db.sql(_ENCODE_LONG, params=[most]).to_arrow_table().sort_by([("word", "ascending"), ("pos", "ascending")])
            word, ids, unsettled = out["word"].to_numpy(), out["id"].to_numpy(), out["round"].to_numpy() == most
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(word)]):
                if not unsettled[a]:
                    self.known[words[word[a]]] = " ".join(map(str, ids[a:b].tolist()))
            rows = {"word": word[unsettled], "pos": out["pos"].to_numpy()[unsettled], "id": ids[unsettled]}
        self.db.execute(f"SET memory_limit = '{MEMORY}'")

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.cache_words:
            for w in list(self.known)[: max(0, len(self.known) - self.cache_words // 2)]:
                if w not in words:
                    del self.known[w]
        todo = []
        for w in words:
            if w not in self.known:
                raw = w.encode()
                if raw in self.ranks:  # a word that is a token takes no contraction
                    self.known[w] = str(self.ranks[raw])
                else:
                    todo.append(w)
        todo.sort(key=len)
        long = [w for w in todo if 4 * len(w) >= LONG and len(w.encode()) >= LONG]
        if long:
            apart = set(long)
            todo = [w for w in todo if w not in apart]
        for part in (todo, long):
            for k in range(0, len(part), QUERY_WORDS):
                self._contract(part[k : k + QUERY_WORDS])

    def encode_all(self, texts: list[str]) -> list[str]:
        """For each text its decimal ids joined by one space."""
        cut = [self.cut(t) for t in texts]
        self.learn({w for words in cut for w in words})
        known = self.known
        return [" ".join([known[w] for w in words]) for words in cut]

    def decode_all(self, ids: np.ndarray, lengths: list[int]) -> list[bytes | None]:
        """What the ids of each list stand for (``ids`` holds them one after the other); None if one is unknown."""
        doc, out = np.repeat(np.arange(len(lengths)), lengths), [[] for _ in lengths]
        for at in range(0, len(ids), DECODE_TOKENS):
            part = ids[at : at + DECODE_TOKENS]
            self.db.register("tokens_", pa.table({"doc": doc[at : at + DECODE_TOKENS], "pos": np.arange(len(part)), "id": part}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("tokens_")
            for k, text, known in zip(found["doc"].to_pylist(), found["text"].to_pylist(), found["known"].to_pylist()):
                out[k].append(text.encode("latin-1") if known else None)
        return [None if None in parts else b"".join(parts) for parts in out]


def _numbers(encoded: list[str]) -> tuple[np.ndarray, list[int]]:
    lengths = [e.count(" ") + 1 if e else 0 for e in encoded]
    every = " ".join([e for e in encoded if e])
    return (np.fromstring(every, np.int32, sep=" ") if every else np.empty(0, np.int32)), lengths


_codecs: dict[tuple, Codec] = {}


def codec(path: str | None = None, pattern: str | None = None, cache_words: int = CACHE_WORDS) -> Codec:
    """This process's codec, made at its first use."""
    key = path, pattern, cache_words
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern, cache_words)
    return _codecs[key]


def _runs(texts: list) -> list[list[str]]:
    out, held = [[]], 0
    for t in texts:
        if out[-1] and held + len(t or "") > RUN_CHARS:
            out.append([])
            held = 0
        out[-1].append(t or "")
        held += len(t or "")
    return out


def token_ids(docs: DataFrame, path: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_tokens and ids (array of int), a row for each row of ``docs``; null and empty texts have no ids."""

    def encode(ids: list, texts: list) -> dict:
        parts, lengths = [np.empty(0, np.int32)], [0]
        for run in _runs(texts):
            flat, n = _numbers(codec(path, cache_words=cache_words).encode_all(run))
            parts.append(flat)
            lengths += n
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(parts)))
        return {"doc_id": ids, "n_tokens": lengths[1:], "ids": lists}

    return map_texts(docs, encode, "doc_id long, n_tokens long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that ``ids`` stands for; null where the bytes are no UTF-8, ids is null or one is null or unknown."""

    def text(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else raw.decode()
        except UnicodeDecodeError:
            return None

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                lists = part.column(1).to_pylist()
                flat = np.array([-1 if i is None else i for ids in lists for i in ids or ()], np.int32)
                raw = codec(path).decode_all(flat, [len(ids or ()) for ids in lists])
                texts = [None if ids is None else text(r) for ids, r in zip(lists, raw)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` with the digests of its ids and of what they decode to; a null text is an empty one."""

    def digest(ids: list, texts: list) -> dict:
        out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for run in _runs(texts):
            encoded = codec(path).encode_all(run)
            flat, lengths = _numbers(encoded)
            out["n_tokens"] += lengths
            out["ids_sha256"] += [hashlib.sha256(e.encode()).hexdigest() for e in encoded]
            out["decoded_sha256"] += [hashlib.sha256(raw).hexdigest() for raw in codec(path).decode_all(flat, lengths)]
        return out

    return map_texts(docs, digest, DIGESTS, most=RUN_CHARS)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
