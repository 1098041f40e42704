"""Recall: lanes, fusion, graph, scores, diversity and packing of a table of questions as one plan; and the context of new facts.

A question sees only facts of its own filters (namespace, user, agent, as-of, event-time window), in every lane and in the
graph. Distinct filters become bits of one long a fact, so a scan of the facts serves ``BITS`` filters and ``lanes.ASKED`` questions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempofact.operators import bitemporal, fusion, graph, inverted, lanes, scoring
from tempofact.session import cut, ship

LINE_SCORE, SECOND_HOP = 0.6, 0.8
BITS = 62
FILTERS = {"namespace": "string", "user_id": "string", "agent_id": "string", "as_of": "timestamp_ntz", "start": "timestamp_ntz", "end": "timestamp_ntz"}
QUESTION = {"query_id": "bigint", "query": "array<double>", "terms": "array<string>", "entities": "array<string>"} | FILTERS


def asked(questions: DataFrame) -> DataFrame:
    """Questions with all columns of ``QUESTION``; absent ones are null, null lists empty."""
    cols = {c: (F.col(c) if c in questions.columns else F.lit(None)).cast(kind) for c, kind in QUESTION.items()}
    cols |= {c: F.coalesce(F.filter(cols[c], lambda x: x.isNotNull()), F.array().cast("array<string>")) for c in ("terms", "entities")}
    return questions.select(*[v.alias(c) for c, v in cols.items()]).where("query_id IS NOT NULL")


def shows(f: Row) -> Column:
    """Whether a fact is shown to a question with the filters ``f``."""
    stamp = lambda x: None if x is None else F.lit(x.isoformat(" ")).cast("timestamp_ntz")
    p = F.col("status") == "active" if f.as_of is None and f.start is None and f.end is None else F.lit(True)
    if f.namespace is not None:
        p = p & (F.col("namespace") == f.namespace)
    if f.user_id is not None:
        p = p & (F.col("user_id") == f.user_id)
    if f.agent_id is not None:
        p = p & bitemporal.visible_to(f.agent_id)
    if f.as_of is not None:
        p = p & bitemporal.as_of(stamp(f.as_of))
    if f.start is not None or f.end is not None:
        p = p & bitemporal.overlaps(stamp(f.start), stamp(f.end))
    return F.coalesce(p, F.lit(False))


def spoken(seen: DataFrame, terms: DataFrame, vocabulary: list[str], bits: int, k: int, index: inverted.Index | None) -> DataFrame:
    """(query_id, id, distance): the ``k`` best facts of each question by Okapi BM25, with the statistics of the facts that it sees.

    ``terms`` are (query_id, bit, term); only postings of the ``vocabulary`` are made, or read from the index.
    """
    ids = seen.where("content IS NOT NULL").select("id", "seen")
    if index is None:
        said = seen.where("content IS NOT NULL").select("id", "seen", lanes.tokens(F.col("content")).alias("w")).withColumn("len", F.size("w"))
        texts = said.select("seen", "len")
        posts = said.select("id", "seen", "len", F.explode(F.filter("w", lambda x: x.isin(vocabulary))).alias("term")).groupBy("id", "seen", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        texts = index.read("texts").join(ids, "id").select("seen", "len")
        posts = index.read("words", vocabulary).select("term", "id", "tf", "len").join(ids, "id")
    shown = lambda b: F.getbit(F.col("seen"), F.lit(b)) == 1
    stats = texts.agg(*[x for b in range(bits) for x in (F.count_if(shown(b)).alias(f"n{b}"), F.avg(F.when(shown(b), F.col("len"))).alias(f"a{b}"))])
    stats = stats.select(F.posexplode(F.array(*[F.struct(F.col(f"n{b}").alias("n"), F.col(f"a{b}").alias("avg")) for b in range(bits)])).alias("bit", "x")).select("bit", "x.n", "x.avg")
    hits = posts.join(F.broadcast(terms), "term").where(F.getbit("seen", "bit") == 1)
    hits = cut(hits.select("query_id", "bit", "id", "term", "tf", "len"), "recall-postings")
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (lanes.K1 + 1) / (F.col("tf") + lanes.K1 * (1 - lanes.B + lanes.B * F.col("len") / F.col("avg")))
    parts = hits.join(F.broadcast(df), ["query_id", "term"]).join(F.broadcast(stats), "bit").groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("xs"))  # a question's terms
    scored = parts.select("query_id", "id", F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["part"]).alias("bm25")).where("bm25 > 0")
    by_query = W.partitionBy("query_id")
    top = scored.withColumn("_n", F.row_number().over(by_query.orderBy(F.round("bm25", 9).desc(), "id"))).where(F.col("_n") <= k)
    return top.select("query_id", "id", (1 - F.col("bm25") / F.max("bm25").over(by_query)).alias("distance"))


def fused(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, id, sim) of both lanes (query_id, id, distance): the better of similarity and fused rank.

    Without keyword hits of a question its similarity stands alone.
    """
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")).cast("long").alias("rank")
    v = vector.select("query_id", "id", F.lit(0).alias("lane"), nth, "distance")
    k = keyword.select("query_id", "id", F.lit(1).alias("lane"), nth, F.lit(1.0).alias("distance"))
    f = v.unionByName(k).groupBy("query_id", "id").agg(F.sum(1.0 / (fusion.K + F.col("rank"))).alias("rrf"), F.min(F.struct("lane", "rank")).alias("first"), F.min("distance").alias("distance"), F.max("lane").alias("lane"))
    every = W.partitionBy("query_id")  # the lanes' own k rows
    pos = F.row_number().over(every.orderBy(F.round("rrf", 9).desc(), "first")) - 1
    by_rank = F.when(F.max("lane").over(every) == 1, 1 - pos / F.count(F.lit(1)).over(every))
    return f.select("query_id", "id", F.greatest(F.lit(0.0), 1 - F.col("distance"), by_rank).alias("sim"))


def candidates(questions: DataFrame, facts: DataFrame, vectors: DataFrame, top: tuple[int, int] = (50, 30), index: inverted.Index | None = None) -> DataFrame:
    """(query_id, id, sim): what both lanes find for each question (columns of ``QUESTION``), fused.

    The questions are a stated set: their filters, vectors and terms reach the driver in blocks, facts never do.
    """
    fields = [*FILTERS]
    distinct = questions.select(*fields).distinct().orderBy(*fields).collect()
    out = None
    for i in range(0, len(distinct), BITS):
        some = distinct[i : i + BITS]
        seen = facts.withColumn("seen", reduce(lambda a, c: a.bitwiseOR(c), [F.when(shows(f), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, f in enumerate(some)])).where("seen <> 0")
        numbers = facts.sparkSession.createDataFrame([(*f, b) for b, f in enumerate(some)], ", ".join([*(f"{c} {k}" for c, k in FILTERS.items()), "bit int"]))
        same = reduce(lambda p, c: p & questions[c].eqNullSafe(numbers[c]), fields, F.lit(True))
        mine = questions.join(F.broadcast(numbers), same).select("query_id", "query", "terms", "bit")
        blocks = max(1, -(-mine.count() // lanes.ASKED))
        for block in range(blocks):
            qs = mine if blocks == 1 else mine.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            rows = qs.collect()
            near = lanes.closest(vectors.where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding").join(seen.select("id", "seen"), "id").select(F.col("id").cast("long"), "seen", "embedding"), [(r.query_id, r.bit, r.query) for r in rows], top[0])
            asks: dict[tuple, int] = {}  # questions of the same filter and words are scored once
            asked_by = [(asks.setdefault((r.bit, *sorted({*r.terms})), len(asks)), r.query_id) for r in rows if r.terms]
            vocabulary = sorted({t for r in rows for t in r.terms})
            if vocabulary:
                spark = facts.sparkSession
                terms = spark.createDataFrame([(n, bit, t) for (bit, *words), n in asks.items() for t in words], "query_id bigint, bit int, term string")
                mates = spark.createDataFrame(asked_by, "ask bigint, query_id bigint")
                said = spoken(seen, terms, vocabulary, len(some), top[1], index).withColumnRenamed("query_id", "ask")
                said = said.join(F.broadcast(mates), "ask").select("query_id", F.col("id").cast("long").alias("id"), "distance")
            else:
                said = near.limit(0)
            got = fused(near, said)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else facts.sparkSession.createDataFrame([], "query_id bigint, id bigint, sim double")


def recall_all(
    questions: DataFrame, facts: DataFrame, vectors: DataFrame, now: Column, *, edges: DataFrame | None = None, nodes: DataFrame | None = None, index: inverted.Index | None = None,
    top: tuple[int, int] = (50, 30), lam: float = 0.7, most: int = 10, gate: float = 0.0, budget: int = 2000,
) -> DataFrame:
    """(query_id, rank, id, source, content, score): the facts that answer each question, best first.

    ``questions`` have columns of ``QUESTION`` (absent ones are null), ``facts`` are rows of the fact table, ``vectors`` (vec_id,
    embedding) theirs, ``edges`` and ``nodes`` the entity graph, ``index`` an inverted index of the facts. Only facts that a
    question's as-of and window show take part in any lane; without both, active ones; namespace, user and agent hold everywhere,
    and of the graph only edges of its namespace that were known by its as-of. Then, in this order: both lanes, fusion, hops from
    the question's entities, the graph's lines (source graph, ids -1, -2 ...), one row a text, recency, entity boost, diversity
    (``most`` rows), confidence by age and use, its ``gate``, and the budget in tokens of four characters; the first row always
    fits. Empty lanes, null entities and null texts are no error; a null text costs nothing.

    What meets in one task is one question's: the ``top`` hits of its lanes and 20 lines of the graph.
    """
    qs = cut(asked(questions), "questions")
    both = cut(candidates(qs, facts, vectors, top, index), "recall-lanes")
    age = ["t_created", "confidence", "access_count", "last_accessed"]
    hits = facts.select(F.col("id").cast("long").alias("id"), "entity", "content", *age).join(both, "id")
    low = F.transform("entities", lambda e: F.lower(e))
    seeds = qs.select("query_id", "namespace", F.date_format("as_of", "yyyy-MM-dd").alias("day"), F.explode(F.array_distinct(low)).alias("key"))
    if edges is not None:
        hits = cut(hits, "recall-hits")
        wanted = hits.select("query_id", F.lower("entity").alias("node")).distinct()
        hop = graph.hops_of(edges, seeds).join(wanted, ["query_id", "node"], "left_semi")
        hits = hits.withColumn("node", F.lower("entity")).join(hop, ["query_id", "node"], "left").drop("node")
    else:
        hits = hits.withColumn("hop", F.lit(None).cast("int"))
    rows = hits.select("query_id", "id", F.lit("vector").alias("source"), "entity", "content", scoring.blend(F.col("sim"), F.col("hop")).alias("score"), *age)
    if edges is not None and nodes is not None:
        lines = graph.context_lines(graph.triples_of(edges, nodes, seeds))
        nth = -F.row_number().over(W.partitionBy("query_id").orderBy("line")).cast("long")
        blank = [now.alias("t_created"), F.lit(1.0).alias("confidence"), F.lit(0).alias("access_count"), F.lit(None).cast("timestamp_ntz").alias("last_accessed")]
        rows = rows.unionByName(lines.select("query_id", nth.alias("id"), F.lit("graph").alias("source"), F.lit(None).cast("string").alias("entity"), F.col("line").alias("content"), F.lit(LINE_SCORE).alias("score"), *blank))

    text = F.coalesce(bitemporal.content_hash("content"), F.concat(F.lit("id "), F.col("id").cast("string")))
    once = W.partitionBy("query_id", text).orderBy(F.desc("score"), "id")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").join(qs.select("query_id", low.alias("low")), "query_id")
    named = F.coalesce(F.array_contains("low", F.lower("entity")), F.lit(False))
    told = F.exists("low", lambda e: (F.length(e) >= 3) & F.coalesce(F.contains(F.lower("content"), e), F.lit(False)))
    boost = F.when(named, 0.3).when(told, 0.15).otherwise(0.0)
    scored = cut(rows.withColumn("score", F.col("score") + scoring.temporal_boost(F.col("t_created"), now) + boost).drop("low"), "recall-scored")
    diverse = scoring.mmr(scored.select("query_id", "id", "score", scoring.words(F.coalesce("content", F.lit(""))).alias("words")), lam, most).select("query_id", "id")
    sure = scoring.decayed_confidence(F.col("confidence"), F.col("access_count"), F.coalesce("last_accessed", "t_created"), now)
    final = scored.join(diverse, ["query_id", "id"]).withColumn("sure", sure).where(F.col("sure") >= gate).withColumn("score", F.col("score") * F.col("sure"))
    return packed(final, budget)


def packed(rows: DataFrame, budget: int) -> DataFrame:
    """(query_id, rank, id, source, content, score): each question's rows, best first, within the budget."""
    items = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "id", "source", "content", "score", F.coalesce(F.length("content") / 4, F.lit(0)).cast("long").alias("cost"))))
    taken = rows.groupBy("query_id").agg(scoring.greedy_pack(items, budget).alias("t")).select("query_id", F.posexplode("t").alias("rank", "t"))  # some dozen rows a question
    return taken.select("query_id", (F.col("rank") + 1).alias("rank"), "t.id", "t.source", "t.content", "t.score")


def recall(
    facts: DataFrame, vectors: DataFrame, query: list[float], terms: list[str], now: Column, *, edges: DataFrame | None = None, nodes: DataFrame | None = None, index: inverted.Index | None = None,
    entities: Sequence[str] = (), as_of: Column | None = None, window: tuple[Column | None, Column | None] | None = None, namespace: str | None = None, user_id: str | None = None, agent_id: str | None = None,
    **options: object,
) -> DataFrame:
    """(rank, id, source, content, score) of one question; see ``recall_all``."""
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    start, end = window or (None, None)
    one = facts.sparkSession.range(1).select(
        F.col("id").alias("query_id"), F.array(*[F.lit(float(x)) for x in query]).alias("query"), texts(terms).alias("terms"), texts(entities).alias("entities"),
        *[(F.lit(v) if v is None or isinstance(v, str) else v).alias(c) for c, v in zip(FILTERS, (namespace, user_id, agent_id, as_of, start, end))],
    )
    return recall_all(one, facts, vectors, now, edges=edges, nodes=nodes, index=index, **options).drop("query_id")


def second_hop(questions: DataFrame, first: DataFrame, text: str = "text", most: int = 5) -> DataFrame:
    """Questions of a second round: up to ``most`` proper nouns of each question's hits, in order of rank, that it does not name itself.

    They keep the question's filters and ask for the noun's words and entity; ``query`` is null, so their vector lane is empty.
    """
    from tempofact.functions.text import proper_nouns

    found = first.where("source = 'vector' AND content IS NOT NULL").select("query_id", F.col("rank").alias("r"), F.posexplode(proper_nouns(F.col("content"), [], 10)).alias("pos", "noun"))
    new = found.join(questions, "query_id").where(~F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower("noun")))
    once = new.groupBy("query_id", F.lower("noun").alias("noun")).agg(F.min(F.struct("r", "pos")).alias("first"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("first", "noun"))
    some = once.withColumn("n", nth).where(F.col("n") <= most)
    rest = [c for c in FILTERS if c in questions.columns]
    return some.join(questions.select("query_id", *rest), "query_id").select("query_id", "n", F.split("noun", " ").alias("terms"), F.array("noun").alias("entities"), F.lit(None).cast("array<double>").alias("query"), *rest)


def multi_hop(questions: DataFrame, facts: DataFrame, vectors: DataFrame, now: Column, *, budget: int = 8000, text: str = "text", **options: object) -> DataFrame:
    """(query_id, rank, id, source, content, score) of two rounds: the second asks for entities that the first found, at 0.8 of its scores."""
    first = cut(recall_all(questions, facts, vectors, now, budget=budget, **options), "first-hop")
    again = cut(second_hop(questions, first, text).withColumn("asked", F.col("query_id")).withColumn("query_id", F.col("query_id") * 8 + F.col("n")), "second-questions")
    second = recall_all(again, facts, vectors, now, budget=2000, **options).join(again.select("query_id", "asked"), "query_id")
    late = second.where("source = 'vector'").groupBy(F.col("asked").alias("query_id"), "id", "source", "content").agg((F.max("score") * SECOND_HOP).alias("score"))
    late = late.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return packed(first.select("query_id", "id", "source", "content", "score").unionByName(late.select("query_id", "id", "source", "content", "score")), budget)


def multi_query(variants: DataFrame, vectors: DataFrame, k: int = 20, limit: int = 20) -> DataFrame:
    """(query_id, id, rrf_score): each question's variants (query_id, variant, query) are lanes of their own, fused by rank.

    A variant without a usable vector is an empty lane; the others stand.
    """
    lanes_ = cut(variants.select("query_id", "variant", "query").where("query_id IS NOT NULL AND variant IS NOT NULL").withColumn("lane", F.xxhash64("query_id", "variant")), "variants")
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.lit(1).cast("long").alias("seen"), "embedding")
    blocks = max(1, -(-lanes_.count() // lanes.ASKED))
    hits = None
    for block in range(blocks):
        some = [(r.lane, 0, r.query) for r in lanes_.where(F.pmod("lane", F.lit(blocks)) == block).collect()]
        near = lanes.closest(rows, some, k).withColumnRenamed("query_id", "lane")
        hits = near if hits is None else hits.unionByName(near)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("lane").orderBy("distance", "id")).cast("long")).join(lanes_.select("lane", "query_id", "variant"), "lane")
    score = ranked.groupBy("query_id", "id").agg(F.bround(F.sum(1.0 / (fusion.K + F.col("rank"))), 6).alias("rrf_score"), F.min(F.struct("variant", "rank")).alias("first"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first"))
    return score.withColumn("_n", nth).where(F.col("_n") <= limit).select("query_id", "id", "rrf_score")


def with_windows(questions: DataFrame, text: str = "text", asked_at: str = "asked_at", tolerance: int = 1) -> DataFrame:
    """Questions whose text has a relative time phrase get its event-time window, unless they bring one of their own."""
    from tempofact.functions.dates import window_at_udf

    found = window_at_udf(tolerance)(F.col(text), F.to_date(asked_at))
    own = [F.col(c) if c in questions.columns else F.lit(None).cast("timestamp_ntz") for c in ("start", "end")]
    free = own[0].isNull() & own[1].isNull()
    return questions.withColumn("_w", found).withColumns({c: F.when(free, F.col(f"_w.{c}").cast("timestamp_ntz")).otherwise(o) for c, o in zip(("start", "end"), own)}).drop("_w")


def bumped(facts: DataFrame, recalled: DataFrame, at: Column) -> DataFrame:
    """Facts after a recall: one access more for each question that got them, last accessed now."""
    times = recalled.where("source = 'vector'").groupBy("id").agg(F.count_distinct("query_id").cast("int").alias("_times"))
    j = facts.join(times, "id", "left")
    return j.withColumns({"access_count": F.col("access_count") + F.coalesce("_times", F.lit(0)), "last_accessed": F.when(F.col("_times").isNotNull(), at).otherwise(F.col("last_accessed"))}).drop("_times")


def context(new: DataFrame, old: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(id, known, n): for each new fact the ``k`` active facts that a resolver sees.

    The most similar ones by vector, where the fact has one in ``queries`` (query_id, query); otherwise the newest of its
    category and entity, or of its category where it has no entity. A null category is met by nothing.
    """
    live = old.where("status = 'active'")
    near = lanes.batch_top_k(vectors.join(live.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), queries, k)
    near = cut(near.select(F.col("query_id").alias("id"), F.col("id").alias("known"), F.col("rank").cast("long").alias("n")), "context")
    rest = new.join(near.select("id"), "id", "left_anti")

    def newest(*keys: str) -> DataFrame:
        n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("t_created"), "id")).cast("long")
        return live.select(*keys, F.col("id").alias("known"), n.alias("n")).where(F.col("n") <= k)

    named = rest.where("entity IS NOT NULL").join(newest("category", "entity"), ["category", "entity"])
    plain = rest.where("entity IS NULL").join(newest("category"), "category")
    return near.unionByName(named.select("id", "known", "n")).unionByName(plain.select("id", "known", "n"))


ship(__name__)
