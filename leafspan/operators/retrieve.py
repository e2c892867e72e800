"""Ranking of sections for questions: by shared words, and by the values of their chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as tx
from leafspan.sources.files import saved, small

TEXT_LIMIT = 12000
CONTEXT_LIMIT = 3000
#: Characters by which short questions meet sections.
GRAM = 3
#: Sections that are scored for every question, so that each has a score that its best ones reach at least.
FIRST = 64
#: The part of that score which words may add that no section is met by.
SHARE = 0.35
#: Shares of the sections at most.
MOST = 5000
#: Pairs of a question and a section that a task may meet.
PAIRS = 1_000_000
#: Query vectors and chunk vectors of a cell, and products that are held at once.
ASKED, MET, PRODUCTS = 8192, 32768, 1 << 20


def _holding(sections: DataFrame, phrases: DataFrame) -> DataFrame:
    """(question_id, section_id) where a section's title or text holds the phrase: met by the phrase's first characters, then searched."""
    keyed = phrases.withColumn("gram", F.left("phrase", F.lit(GRAM)))
    text = F.concat_ws("\n", F.lower("title"), F.lower("text"))
    found = None
    for n in range(1, GRAM + 1):  # phrases shorter than GRAM have keys of their own lengths
        grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        own = keyed.filter(F.length("gram") == n)
        if not own.isEmpty():
            met = sections.select("section_id", F.explode(grams).alias("gram")).join(own, "gram").select("question_id", "section_id", "phrase")
            found = met if found is None else found.unionAll(met)
    texts = sections.select("section_id", F.lower("title").alias("_title"), F.lower("text").alias("_text"))
    inside = F.col("_text").contains(F.col("phrase")) | F.col("_title").contains(F.col("phrase"))
    return found.join(texts, "section_id").filter(inside).select("question_id", "section_id")


def _listed(sections: DataFrame) -> DataFrame:
    """Sections with the distinct words of their title (t), of their text's first part (x) and of the rest (later), and their block: the title's words in powers of two."""
    whole, title = tx.retrieval_tokens(F.col("text")), tx.retrieval_tokens(F.col("title"))
    first = F.when(F.length("text") > TEXT_LIMIT, tx.retrieval_tokens(F.left("text", F.lit(TEXT_LIMIT)))).otherwise(whole)
    empty = F.array().cast("array<string>")
    listed = sections.select("section_id", "ord", *(F.coalesce(c, empty).alias(n) for c, n in ((title, "t"), (first, "x"), (whole, "w"))))
    later = F.when(F.size("x") < F.size("w"), F.array_except("w", "x")).otherwise(empty)
    block = F.length(F.bin(F.size("t").cast("long"))) * (F.size("t") > 0).cast("int")
    return saved(listed.select("section_id", "ord", "t", "x", later.alias("later"), block.alias("block")), "section-words")


def _thresholds(listed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(question_id, least): a score that k sections reach at least. The FIRST sections with the greatest possible scores are scored for all questions."""
    first = listed.orderBy(F.desc(2 * F.size("t") + F.size("x")), "ord").limit(FIRST)
    words = first.select("section_id", F.size("t").alias("n_t"), F.posexplode(F.concat("t", "x")).alias("i", "word"))
    met = words.join(asked.select("question_id", F.explode("words").alias("word")), "word").groupBy("question_id", "section_id")
    scores = met.agg(F.sum(F.when(F.col("i") < F.col("n_t"), 2).otherwise(1)).alias("score"))
    best = F.slice(F.sort_array(F.collect_list("score"), False), k, 1)  # of FIRST scores at most
    return scores.groupBy("question_id").agg(F.coalesce(F.get(best, 0), F.lit(0)).alias("least"))


def _essential(listed: DataFrame, asked: DataFrame, least: DataFrame) -> DataFrame:
    """(question_id, block, word, n, essential, rest, least): the words that a block's sections are met by.

    A section of a block cannot get more than one for each of the other ``rest`` words, the most frequent ones, and two more for
    as many as its title may hold; they are as many as leave this below SHARE of the least score. The three rarest words
    stay in any case: a section that holds the whole question shares one of them.
    """
    blocks = [r[0] for r in listed.select("block").distinct().collect()]  # 33 at most
    own = asked.select("question_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    everywhere = listed.select(F.explode(F.array_union(F.array_union("t", "x"), "later")).alias("word"))
    count = everywhere.join(small(own.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("sections"))
    rarest = Window.partitionBy("question_id").orderBy("sections", "word")
    ranked = own.join(count, "word").withColumn("r", F.row_number().over(rarest)).join(least, "question_id", "left").na.fill({"least": 0})
    # words that occur nowhere are left out, so n - r counts from the most frequent one
    ranked = ranked.withColumn("n_met", F.count("*").over(Window.partitionBy("question_id")))
    rows = ranked.withColumn("block", F.explode(F.array(*(F.lit(b) for b in blocks)))) if blocks else ranked.withColumn("block", F.lit(0)).limit(0)
    title = F.pow(F.lit(2), F.col("block")) - 1
    share = F.col("least") * SHARE
    bound = F.ceil(share / 3) - 1
    rest = F.when(bound <= title, bound).otherwise(F.greatest(title, F.ceil(share - 2 * title) - 1))
    rest = F.greatest(F.least(rest, F.col("n_met") - 3), F.lit(0)).cast("int")
    rows = rows.withColumn("rest", rest).withColumn("essential", F.col("n_met") - F.col("rest")).filter(F.col("r") <= F.col("essential"))
    return saved(rows.select("question_id", "block", "word", "n", "n_met", "essential", "rest", "least"), "essential-words")


def _candidates(listed: DataFrame, lists: DataFrame) -> DataFrame:
    """(question_id, section_id, shared) of pairs whose score may reach the question's least one.

    Words are dealt by section, so that they are counted where they are met, and only pairs that stay leave. There
    are as many shares as keep a task's pairs at about PAIRS, MOST shares at most.
    """
    pairs = listed.count() * lists.select("question_id").distinct().count()
    shares = max(listed.sparkSession.sparkContext.defaultParallelism, min(-(-pairs // PAIRS), MOST))
    words = listed.select("section_id", "block", F.size("t").alias("n_t"), F.size("x").alias("n_x"), F.concat("t", "x", "later").alias("words"))
    # outer: the optimizer would read the arrays again to test for words, were sections without any left out here
    words = words.repartition(shares, "section_id").select("section_id", "block", "n_t", "n_x", F.posexplode_outer("words").alias("i", "word"))
    in_title, in_first = F.col("i") < F.col("n_t"), F.col("i") < F.col("n_t") + F.col("n_x")
    met = words.join(small(lists), ["word", "block"]).groupBy("section_id", "question_id")
    sums = met.agg(
        F.sum(in_title.cast("int")).alias("st"),
        F.sum((in_first & ~in_title).cast("int")).alias("sx"),
        F.sum((~in_title).cast("int")).alias("sw"),
        *(F.first(c).alias(c) for c in ("n_t", "n_x", "n", "n_met", "essential", "rest", "least")),
    )
    most = F.greatest("st", "sw")
    # phrases lack two words at most, words that occur nowhere among them
    bonus = F.when(most + F.col("rest") >= F.col("n") - 2, 5).otherwise(0)
    reach = 2 * F.col("st") + F.col("sx") + F.least("rest", F.col("n_x") - F.col("sx")) + 2 * F.least("rest", F.col("n_t") - F.col("st")) + bonus
    return saved(sums.filter(reach >= F.col("least")).select("question_id", "section_id"), "pairs")


def likely_scores(sections: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, section_id, ord, score) for all pairs that can be among a question's best k; further pairs may be missing or too low.

    ``sections`` has section_id, ord, title, text; ``questions`` has question_id,
    text. A shared title word counts 2, a shared word of the text's first part 1, the whole question in
    the title 3, in the text 2. Posting lists are kept apart by blocks, in which a word's impact has an upper bound;
    a question is only met by its rarer words there, as long as what the others could add stays below the
    score that k sections have at least. Pairs that may reach that score are scored in full. Texts are only
    searched for questions where all words but the first and the last are shared (those
    two may be parts of words). Questions of one or two words may lie within words, where nothing is shared;
    they meet sections by their first characters.
    """
    listed = _listed(sections)
    asked = questions.select("question_id", tx.retrieval_tokens(F.col("text")).alias("words"), F.lower(F.trim("text")).alias("phrase"))
    pairs = _candidates(listed, _essential(listed, asked, _thresholds(listed, asked, k)))
    shared = lambda c: F.size(F.array_intersect(c, F.col("words")))
    full = listed.join(small(pairs), "section_id").join(asked.select("question_id", "words"), "question_id")
    full = full.select(
        "question_id",
        "section_id",
        "ord",
        (2 * shared("t") + shared("x")).alias("score"),
        (F.greatest(shared("t"), shared("x") + shared("later")) >= F.size("words") - 2).alias("likely"),
    )
    full = saved(full, "scored")
    texts = sections.select("section_id", F.lower("title").alias("_title"), F.lower("text").alias("_text"))
    phrase = F.col("phrase")
    bonus = (phrase != "").cast("int") * (F.coalesce(F.col("_title").contains(phrase), F.lit(False)).cast("int") * 3 + F.coalesce(F.col("_text").contains(phrase), F.lit(False)).cast("int") * 2)
    names = ["question_id", "section_id", "ord", "score"]
    phrases = asked.select("question_id", "phrase")
    searched = full.filter("likely").join(phrases, "question_id").join(texts, "section_id").withColumn("score", F.col("score") + bonus)
    out = full.filter("NOT likely").select(names).unionAll(searched.select(names))
    few = asked.filter((F.size("words") <= 2) & (phrase != "")).select("question_id", "phrase")
    if not few.isEmpty():
        inside = _holding(sections, few).join(pairs, ["question_id", "section_id"], "left_anti").distinct()
        inside = inside.join(few, "question_id").join(texts.join(sections.select("section_id", "ord"), "section_id"), "section_id")
        out = out.unionAll(inside.withColumn("score", bonus).select(names))
    return out.withColumn("score", F.col("score").cast("long"))


def top_sections(sections: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, rank, section_id, score): the best k sections per question by score, then ord.

    A question that shares nothing with any section gets the first k sections with score 0.
    """
    k = max(1, k)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")
    best = likely_scores(sections, questions, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = saved(best.select("question_id", F.col("rank").cast("long").alias("rank"), "section_id", "score"), "best")
    ranked = sections.select("section_id", "ord").orderBy("ord").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("ord")).cast("long"))
    none = questions.select("question_id").join(best, "question_id", "left_anti")
    none = none.withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))).join(ranked, "rank")
    return best.unionAll(none.select("question_id", "rank", "section_id", F.lit(0).cast("long").alias("score")))


def answer_context(ranked: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, context): the ranked sections' titles, pages and clipped texts in one text."""
    s = sections.join(small(ranked), "section_id")  # few are ranked: texts stay where they are
    part = F.concat(
        F.lit("[Section "),
        F.col("rank").cast("string"),
        F.lit("] title: "),
        "title",
        F.lit("\npages: "),
        F.col("start_index").cast("string"),
        F.lit("-"),
        F.col("end_index").cast("string"),
        F.lit("\ntext:\n"),
        F.left("text", F.lit(CONTEXT_LIMIT)),
    )
    parts = s.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("p"))
    return parts.select("question_id", F.array_join("p.t", "\n\n").alias("context"))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _best_products(k: int):
    """The k best chunks of each query of a cell: products of two blocks of vectors, a few queries at a time."""
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("node_id", pa.int64()), ("product", pa.float64())])

    def best(key, asked, chunks):
        if not asked.num_rows or not chunks.num_rows:
            return schema.empty_table()
        chunks = chunks.sort_by("chunk_id")
        one, two = _vectors(asked.column("asked")), _vectors(chunks.column("met"))
        rows, found, products = [], [], []
        step = max(1, PRODUCTS // len(two))
        for i in range(0, len(one), step):
            product = one[i:i + step] @ two.T
            lack = -np.round(product, 9)
            last = np.partition(lack, k - 1, axis=1)[:, k - 1, None] if len(two) > k else np.inf
            row, place = np.nonzero(~(lack > last))  # all that reach the k-th best one, equal ones too
            order = np.lexsort((place, lack[row, place], row))
            row, place = row[order], place[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, place = row[rank < k], place[rank < k]
            rows.append(row + i)
            found.append(place)
            products.append(product[row, place])
        rows, found = np.concatenate(rows), np.concatenate(found)
        columns = [asked.column("query_id").take(rows), chunks.column("chunk_id").take(found), chunks.column("node_id").take(found)]
        return pa.Table.from_arrays([*columns, pa.array(np.concatenate(products))], schema=schema)

    return best


def node_values(chunks: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, node_id, n, value): a node's value is the sum of its chunks' products among the query's k best, over sqrt(n + 1).

    ``queries`` has query_id, embedding; ``chunks`` has chunk_id, node_id, embedding, of one length; rows
    without an embedding take no part. Every query meets every chunk, a block of queries and a block of chunks at
    a time; only the k best of a block leave it. Equal products go by chunk_id.
    """
    queries, chunks = (t.filter("embedding IS NOT NULL") for t in (queries, chunks))
    many = lambda t, size: max(1, -(-t.count() // size))
    rows, columns = many(queries, ASKED), many(chunks, MET)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("asked"), block("query_id", rows).alias("i"), every(columns).alias("j"))
    met = chunks.select(F.col("chunk_id").alias("chunk_id"), F.col("node_id").cast("long").alias("node_id"), F.col("embedding").alias("met"), block("chunk_id", columns).alias("j"), every(rows).alias("i"))
    best = asked.groupBy("i", "j").cogroup(met.groupBy("i", "j")).applyInArrow(
        _best_products(k), "query_id long, chunk_id long, node_id long, product double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("product", 9)), "chunk_id")
    best = best.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    n = F.count("*")
    return best.groupBy("query_id", "node_id").agg(n.alias("n"), (F.sum("product") / F.sqrt(n + 1)).alias("value"))
