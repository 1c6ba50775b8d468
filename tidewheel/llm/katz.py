"""Katz backoff language model over the words of a corpus: counted, normalised and evaluated in one pass of packed shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import words
from tidewheel.llm.blocks import ask, bucket_of, gaps, in_blocks, pack, runs, unpack
from tidewheel.llm.tables import discard, durable, whole_text

#: Counts up to K are discounted; those above keep all but DELTA of an event, so that no history is left without backoff mass.
K, DELTA = 5, 0.01
BLOCK_BYTES = 8 << 20
#: Tokens of a bucket of histories; a history with more than a quarter of that is spread by its next words.
BUCKET_TOKENS = 1 << 21
_START, _END = np.uint64(0x51A27D3C9E4B0F61), np.uint64(0x0D15EA5E0FF1CE77)
_WIDTH = 2 * K + 2
#: Words after a history are told apart by 48 bits.
_SHORT = np.uint64(16)

TABLE = "kind string, block long, h long, stats array<double>, body binary"


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds ``x``."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class _Sequences:
    """The token sequences of a block: words of each text, then one end."""

    def __init__(self, table: pa.Table):
        h, c = words.word_hashes(*words.text_bytes(table.column("text")))
        self.rows, self.n = len(c), c + 1
        ends = np.cumsum(self.n)
        self.token = np.full(ends[-1] if len(ends) else 0, _END)
        self.token[np.arange(len(h)) + np.repeat(np.arange(self.rows), c)] = h
        self.doc = np.repeat(np.arange(self.rows), self.n)
        self.first = ends - self.n
        self.held = np.asarray(table.column("held_out").to_numpy(zero_copy_only=False) if isinstance(table.column("held_out"), pa.Array) else table.column("held_out").to_numpy(), bool)
        self.types, self.type = np.unique(self.token, return_inverse=True)


def _send_words(buckets: int):
    def send(table: pa.Table):
        s = _Sequences(table)
        counts = np.bincount(s.type[~s.held[s.doc]], minlength=len(s.types))
        for bucket, a, b in runs(bucket_of(s.types, buckets)):
            yield bucket, pack(gaps(s.types[a:b]), _small(counts[a:b]))

    return send


def _answer_words(bodies: list[bytes]) -> list[bytes]:
    """The training count of every word asked for, and whether the asker is the first (who reports it in the totals)."""
    parts = [unpack(b) for b in bodies]
    keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)[inverse]
    owner = np.zeros(len(keys), np.uint8)
    owner[first] = 1
    cuts = np.cumsum([len(k) for k, _ in parts])[:-1]
    return [pack(_small(c), o) for c, o in zip(np.split(total, cuts), np.split(owner, cuts), strict=True)]


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """How many are 1 .. K + 1."""
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2)[1:]


def _pairs(buckets: int, hot: int):
    """Each block's tokens with their history, dealt by history; totals and the columns of the contract beside them."""

    def finish(block: int, table: pa.Table, replies: list[tuple[int, bytes]]) -> pa.Table:
        s = _Sequences(table)
        got = [unpack(body) for _, body in replies]
        count = np.concatenate([c for c, _ in got]).astype(np.int64)
        own = count[np.concatenate([o for _, o in got]).astype(bool)]
        c = count[s.type]
        base = np.bincount(s.doc, weights=np.log10(c + 1.0), minlength=s.rows)
        known = np.bincount(s.doc, weights=c > 0, minlength=s.rows).astype(np.int64)
        ids = table.column("doc_id")
        valid = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.is_valid().to_numpy(), np.uint8)
        # training documents go first, so that an index says which a document is
        turn = np.argsort(s.held, kind="stable")
        rank = np.empty(s.rows, np.int64)
        rank[turn] = np.arange(s.rows)
        training = np.array([s.rows - s.held.sum()], np.int64)
        stats = [float(own.sum()), float((own > 0).sum()), *_counts_of_counts(own).astype(float).tolist(), float(training[0])]
        rows = [(-1 - block, "doc", stats, pack(ids.fill_null(0).to_numpy().astype(np.int64)[turn], valid[turn], s.n.astype(np.int64)[turn], known[turn], base[turn], s.held[turn].astype(np.uint8)))]
        history = np.empty_like(s.type)
        history[1:] = s.type[:-1]
        history[s.first] = len(s.types)
        hash_of = np.append(s.types, _START)
        count_of = np.append(count, 0)  # the start's count is known once all blocks are
        spread = np.append(count > hot, True)
        key = np.where(spread[history], words.mix(hash_of[history] ^ words.mix(s.token)), words.mix(hash_of[history]))
        bucket = bucket_of(key, buckets)
        doc = rank[s.doc]
        order = np.lexsort((doc, s.type, history, bucket))
        history, word, doc = history[order], s.type[order], doc[order]
        for b, i, j in runs(bucket[order]):
            h, hi = np.unique(history[i:j], return_inverse=True)
            w, wi = np.unique(word[i:j], return_inverse=True)
            body = pack(hash_of[h], count_of[h], spread[h].astype(np.uint8), gaps(s.types[w] >> _SHORT), _small(count[w]), _small(hi), _small(wi), _small(doc[i:j]), training)
            rows.append((b, "pairs", None, body))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "kind": pa.array([r[1] for r in rows]), "stats": pa.array([r[2] for r in rows], pa.list_(pa.float64())), "body": pa.array([r[3] for r in rows], pa.binary())})

    return finish


def _by_class(group: np.ndarray, count: np.ndarray, groups: int) -> np.ndarray:
    """For each group: how many counts are 1 .. K, and the sum of those above, less DELTA each."""
    out = np.zeros((groups, K + 1))
    low = count <= K
    np.add.at(out, (group[low], count[low] - 1), 1)
    out[:, K] = np.bincount(group[~low], weights=count[~low] - DELTA, minlength=groups)
    return out


def _count_pairs(table: pa.Table) -> pa.Table:
    """All tokens after a bucket's histories: pair counts, what each document's pairs add up to, and backoff sums of the histories.

    What depends on the discounts, which need all buckets, leaves as counts by class.
    """
    out: list[tuple] = []
    table = table.sort_by("block")
    kinds, blocks, all_stats, bodies = (table.column(n).to_pylist() for n in ("kind", "block", "stats", "body"))
    pairs = []
    for kind, block, stats, body in zip(kinds, blocks, all_stats, bodies, strict=True):
        if kind == "doc":
            out.append(("doc", block, None, stats, body))
        else:
            pairs.append((block, *unpack(body)))
    if pairs:
        h = np.concatenate([p[1][p[6]] for p in pairs])
        w = np.concatenate([np.cumsum(p[4], dtype=np.uint64)[p[7]] for p in pairs])
        wc = np.concatenate([p[5][p[7]].astype(np.int64) for p in pairs])
        held = np.concatenate([p[8] >= p[9][0] for p in pairs])
        _, first, pair = np.unique(words.mix(h * np.uint64(0x9E3779B97F4A7C15) + words.mix(w)), return_index=True, return_inverse=True)
        r_type = np.bincount(pair, weights=~held).astype(np.int64)
        histories, hi = np.unique(h, return_inverse=True)
        info = dict(zip(np.concatenate([p[1] for p in pairs]).tolist(), zip(np.concatenate([p[2] for p in pairs]).tolist(), np.concatenate([p[3] for p in pairs]).tolist(), strict=True), strict=True))
        total = np.array([info[x][0] for x in histories.tolist()], np.int64)
        spread = np.array([info[x][1] for x in histories.tolist()], bool)
        seen = r_type > 0
        at, r = hi[first[seen]], r_type[seen]
        sums = np.hstack([_by_class(at, r, len(histories)), _by_class(at, wc[first[seen]], len(histories))])
        out.append(("n2", None, None, _counts_of_counts(r).astype(float).tolist(), None))
        for k in np.flatnonzero(spread):
            out.append(("hist", None, int(histories[k].view(np.int64)), sums[k].tolist(), None))
        r = r_type[pair]
        end = 0
        for block, *_, docs, _ in pairs:
            begin, end = end, end + len(docs)
            some = r[begin:end] > 0
            rr, hh, dd = r[begin:end][some], hi[begin:end][some], docs[some]
            ids, di = np.unique(dd, return_inverse=True)
            start = histories[hh] == _START
            value = np.where(rr > K, np.log10(np.maximum(rr, K + 1) - DELTA), 0) - np.log10(np.where(start, 1, np.maximum(total[hh], 1)))
            classes = np.zeros((len(ids), K + 1), np.int64)
            np.add.at(classes, (di[rr <= K], rr[rr <= K] - 1), 1)
            classes[:, K] = np.bincount(di[start], minlength=len(ids))
            if len(ids):
                out.append(("seen", block, None, None, pack(_small(ids), np.bincount(di, weights=value), _small(classes.reshape(-1)))))
            rest = np.flatnonzero(~some) + begin
            near = rest[~spread[hi[rest]]]
            if len(near):
                used, ui = np.unique(hi[near], return_inverse=True)
                out.append(("back", block, None, None, pack(_small(docs[near - begin]), _small(wc[near]), _small(ui), total[used], sums[used].reshape(-1))))
            far = rest[spread[hi[rest]]]
            for k in np.unique(hi[far]):
                sel = far[hi[far] == k]
                out.append(("hotback", block, int(histories[k].view(np.int64)), [float(total[k])], pack(_small(docs[sel - begin]), _small(wc[sel]))))
    return pa.table({"kind": pa.array([o[0] for o in out], pa.string()), "block": pa.array([o[1] for o in out], pa.int64()), "h": pa.array([o[2] for o in out], pa.int64()), "stats": pa.array([o[3] for o in out], pa.list_(pa.float64())), "body": pa.array([o[4] for o in out], pa.binary())})


def discounts(n: list[float]) -> np.ndarray:
    """Good-Turing discount of counts 1 .. K from how many events were seen 1 .. K + 1 times.

    Where the counts of counts give none between 0 and 1, the count loses half an event.
    """
    out = np.array([(r - 0.5) / r for r in range(1, K + 1)])
    share = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        if n[r - 1] and share < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share)
            if 0 < d < 1:
                out[r - 1] = d
    return out


def _final(d1: np.ndarray, d2: np.ndarray, tokens: float, unknown: float, starts: float):
    r = np.arange(1, K + 1)

    def unigram(c: np.ndarray) -> np.ndarray:
        low = np.clip(c, 1, K) - 1
        return np.where(c > K, (c - DELTA) / max(tokens, 1), np.where(c > 0, d1[low] * c / max(tokens, 1), unknown))

    def backoff(total: np.ndarray, sums: np.ndarray) -> np.ndarray:
        seen = 1 - (sums[:, :K] @ (d2 * r) + sums[:, K]) / np.maximum(total, 1)
        rest = 1 - (sums[:, K + 1 : 2 * K + 1] @ (d1 * r) + sums[:, 2 * K + 1]) / max(tokens, 1)
        return np.where(total > 0, seen / rest, 1.0)

    def finish(table: pa.Table) -> pa.Table:
        order = {"doc": 0, "seen": 1, "back": 2, "hotback": 3}
        rows = sorted(zip(table.column("kind").to_pylist(), table.column("h").to_pylist(), table.column("stats").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda x: (order[x[0]], x[1] or 0, x[3]))
        ids, valid, n, known, base, held = unpack(rows[0][3])
        score = np.zeros(len(ids))
        for kind, _, stats, body in rows[1:]:
            x = unpack(body)
            if kind == "seen":
                classes = x[2].reshape(-1, K + 1)
                score[x[0]] += x[1] + classes[:, :K] @ np.log10(d2 * r) - classes[:, K] * np.log10(max(starts, 1))
            elif kind == "back":
                alpha = backoff(x[3].astype(float), x[4].reshape(-1, _WIDTH))
                score += np.bincount(x[0], weights=np.log10(alpha[x[2]] * unigram(x[1].astype(np.int64))), minlength=len(ids))
            else:
                total = starts if stats[_WIDTH] == 0 else stats[_WIDTH]
                alpha = backoff(np.array([total]), np.array([stats[:_WIDTH]]))
                score += np.bincount(x[0], weights=np.log10(alpha[0] * unigram(x[1].astype(np.int64))), minlength=len(ids))
        return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(known), "log_counts": pa.array(base), "score": pa.array(score)})

    return finish


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", held_out=None, order: int = 2) -> DataFrame:
    """Every text's log10 probability under a Katz bigram model of the texts that aren't held out.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are the lower-cased
    words between white space and one end a text. P(w | h) = d c(h, w) / c(h) for pairs seen in training, with
    Good-Turing discounts up to ``K``; else alpha(h) P(w), alpha such that a history's probabilities over all
    words and one unknown word sum to exactly 1; a history never seen backs off with 1. P(w) is discounted in the
    same way and leaves the rest to the unknown word.

    Blocks of documents ask word buckets for the counts of their words, then deal their tokens by history; a history
    with a large share of all tokens is dealt by its next words and its sums are joined. The partitioned result
    table holds sums by class; with all counts of counts known the backoff is evaluated from it. Words are kept as
    64-bit hashes. Null ids and texts are allowed (a null id counts as empty text for the default ``held_out``,
    crc32 of the id modulo 7 being 2); repeated rows count and are scored each; other columns are left out. With
    no training text all scores are 0. Any other ``order`` than 2 is counted and evaluated by ``katz_tables``.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2 if held_out is None else held_out
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"), held.alias("held_out"))
    if order != 2:
        from tidewheel.llm import katz_tables

        model = katz_tables.fit(own.where(~F.col("held_out")), order)
        found = katz_tables.score(model, own)
        tokens, types = model.tokens, model.types
        base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") if tokens else F.lit(0.0)).alias("score"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // (6 * BUCKET_TOKENS)) + 1
    sent = ask(in_blocks(own, BLOCK_BYTES), _send_words(buckets), _answer_words, _pairs(buckets, BUCKET_TOKENS // 4), "bucket long, block long, kind string, stats array<double>, body binary")
    table, path = durable(sent.groupBy("bucket").applyInArrow(_count_pairs, TABLE), partition_by=("kind",))
    table = table.select("kind", "block", "h", "stats", "body")

    def sums(kind: str, width: int):
        return [float(x or 0) for x in table.where(F.col("kind") == kind).agg(*[F.sum(F.col("stats")[i]) for i in range(width)]).first()]

    tokens, types, *n1, starts = sums("doc", K + 4)
    d1, d2 = discounts(n1), discounts(sums("n2", K + 1))
    low = np.arange(1, K + 1)
    mass = (d1 * low) @ n1[:K] + (tokens - low @ n1[:K]) - DELTA * (types - sum(n1[:K]))
    unknown = 1 - mass / tokens if tokens else 1.0
    hist = table.where("kind = 'hist'").groupBy("h").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(_WIDTH)])
    hist = hist.select(F.col("h").alias("_h"), F.array(*[f"s{i}" for i in range(_WIDTH)]).alias("_sums"))
    hot = table.where("kind = 'hotback'").join(hist, F.col("h") == F.col("_h")).select("kind", "block", "h", F.concat("_sums", "stats").alias("stats"), "body")
    rest = table.where("kind IN ('doc', 'seen', 'back')")
    scored = rest.unionByName(hot).groupBy("block").applyInArrow(_final(d1, d2, tokens, unknown, starts), "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    found, _ = durable(scored)
    discard(spark, path)
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(tokens + types + 1))
    score = F.col("score") if tokens else F.lit(0.0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op7_katz_scores(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
