"""Every registered query: a name and a function of session and table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.catalog import adapters as D
from themeloom.functions import markdown as M
from themeloom.functions import prompts as P
from themeloom.functions import scoring as S
from themeloom.functions import text as T
from themeloom.functions.responses import parsed_answers, parsed_topics, without_fence
from themeloom.operators import clusters as C
from themeloom.operators import kmeans_starts as KS
from themeloom.operators import grouping as G
from themeloom.operators import responder as B
from themeloom.operators import retrieval as R
from themeloom.operators import rollups as U
from themeloom.operators import vector_index as X
from themeloom.operators import terms as V
from themeloom.operators.completion import complete
from themeloom.operators.silhouette import silhouette, silhouette_points
from themeloom.operators.storage import shared_folder, written
from themeloom.plans import stage1 as one
from themeloom.plans import stage2 as two
from themeloom.plans import term_store as TS
from themeloom.settings import Settings
from themeloom.shipping import ship
from themeloom.sources.word import blocks_to_articles, word_blocks
from themeloom import fixed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOOSE = 0.3
QUESTION = ["thing", "tion", "eau", "schst", "que"]
CHUNK, OVERLAP = 120, 20
K = 20


# Positions and counts that SQL gives as BIGINT.
WIDE = {
    "topic_prompts": ["window_no"],
    "vocabulary_topn": ["slot"],
    "tfidf_within_article": ["topic_no"],
    "topic_similarity_pairs": ["i", "j"],
    "topic_similarity_pairs_loose": ["i", "j"],
    "topic_copies": ["topic_no", "representative"],
    "topic_leaders": ["topic_no", "leader_no"],
    "topic_leaders_loose": ["topic_no", "leader_no"],
    "merged_topics": ["leader_no", "cluster_size"],
    "merged_topics_loose": ["leader_no", "cluster_size"],
    "builtin_topics": ["topic_no"],
    "builtin_themes": ["theme_no"],
    "cluster_themes_top20": ["shown_no"],
    "stage2_summary": ["n_clusters"],
    "vector_topk": ["rank"],
    "vector_index_topk": ["rank"],
    "retrieve_local": ["rank"],
    "retrieve_global": ["rank"],
    "term_store_local": ["rank"],
    "term_store_global": ["rank"],
    "retrieve_hybrid": ["best_rank", "rank"],
}


def query(run: Query) -> Query:
    wide = WIDE.get(run.__name__, [])

    def registered(spark: SparkSession, folder: str) -> DataFrame:
        found = run(ship(spark), folder)
        return found.withColumns({c: F.col(c).cast("long") for c in wide}) if wide else found

    QUERIES[run.__name__] = registered
    return run


def joined(column) -> F.Column:
    return F.array_join(column, "|", "-")


# --- text and markdown -------------------------------------------------------


@query
def clean_text(spark, folder):
    docs = D.table(spark, folder, "documents")
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def word_count(spark, folder):
    docs = D.table(spark, folder, "documents")
    return docs.select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query
def content_cap(spark, folder):
    docs = D.table(spark, folder, "documents")
    capped = T.content_cap(F.col("text"), Settings().content_cap)
    return docs.select("doc_id", capped.alias("shown"))


@query
def metadata_envelope(spark, folder):
    docs = D.documents(spark, folder)
    envelope = T.metadata_envelope(F.col("filename"), F.col("word_count"), F.col("content"))
    return docs.select("doc_id", envelope.alias("envelope"))


@query
def title_case(spark, folder):
    docs = D.table(spark, folder, "documents")
    name = F.concat(
        "source", F.lit("-"), "lang", F.lit("_it's o'neil "), "doc_id", F.lit("rd.été.docx")
    )
    stem = T.file_stem(name)
    return docs.select(
        "doc_id",
        T.document_title(stem).alias("title"),
        T.markdown_name(name).alias("output_name"),
    )


@query
def heading_level(spark, folder):
    docs = D.table(spark, folder, "documents")
    number = (F.col("n_chars") % 23).cast("string")
    style = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("heading "), number))
        .when(F.col("doc_id") % 5 == 1, F.lit("Heading"))
        .when(F.col("doc_id") % 5 == 2, F.col("source"))
        .otherwise(F.concat(F.lit("Heading "), number))
    )
    return docs.select(
        "doc_id",
        style.alias("style"),
        M.heading_level(style).alias("level"),
        M.heading_level_lowercase(style).alias("plain_level"),
    )


@query
def emphasis(spark, folder):
    docs = D.table(spark, folder, "documents")
    run = lambda body, bold, italic: F.struct(
        body.alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic")
    )
    first = F.substring_index("text", " ", 1)
    runs = F.array(
        run(first, True, True),
        run(F.lit(""), True, False),
        run(F.col("lang"), None, True),
        run(F.lit("e"), False, None),
    )
    return docs.select("doc_id", M.emphasised(F.col("text"), runs).alias("marked"))


@query
def table_markdown(spark, folder):
    docs = D.table(spark, folder, "documents")
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r"[.] *"))
    wide = F.transform(rows, lambda r: F.concat(r, F.array(F.lit("a|b"))))
    padded = F.concat(F.array(F.array(F.lit(" "), F.lit(""))), F.array(F.array(F.lit(" x "))), wide)
    return docs.select(
        "doc_id",
        F.array_join(M.table_lines(padded), "\n").alias("lines"),
        F.array_join(M.plain_table_lines(rows), "\n").alias("plain_lines"),
    )


@query
def block_markdown(spark, folder):
    blocks = D.page_blocks(spark, folder)
    return blocks.select(
        "page_id",
        M.blocks_to_markdown(F.col("paragraphs"), F.col("tables")).alias("markdown"),
        M.blocks_to_plain_markdown(F.col("paragraphs"), F.col("tables")).alias("plain_markdown"),
    )


@query
def word_to_markdown(spark, folder):
    blocks = word_blocks(D.word_files(spark, folder))
    return blocks_to_articles(blocks).select(
        "doc_id", "title", "output_name", "content", "word_count", F.col("error").isNull().alias("ok")
    )


@query
def word_to_plain_markdown(spark, folder):
    blocks = word_blocks(D.word_files(spark, folder))
    return blocks_to_articles(blocks, "plain").select(
        "doc_id", "content", F.col("error").isNull().alias("ok")
    )


@query
def conversion_outcome(spark, folder):
    blocks = word_blocks(D.word_files(spark, folder, cut=True))
    return U.failure_counts(blocks.select("error"))


# --- prompts and answers -----------------------------------------------------


@query
def topic_prompts(spark, folder):
    return one.topic_prompts(D.documents(spark, folder), "doc_id", Settings())


@query
def theme_prompts(spark, folder):
    topics = D.turn_topics(spark, folder)
    lists = one.records_of(
        D.conversations(spark, folder).where(F.col("error").isNull()),
        topics,
        "conv_id",
        Settings(similarity_threshold=LOOSE),
    )
    return lists.select("conv_id", P.theme_prompt(F.col("clustered_topics")).alias("prompt"))


def _cluster_themes(rows):
    return two.themes_of(rows, "doc_id", "cluster_number")


@query
def cluster_prompts(spark, folder):
    rows = D.document_themes(spark, folder)
    sizes = C.cluster_sizes(rows)
    lines = C.shown_theme_lines(_cluster_themes(rows), "doc_id", Settings().shown_themes)
    return sizes.join(lines, "cluster_number").select(
        "cluster_number", P.cluster_prompt(F.col("size"), F.col("lines")).alias("prompt")
    )


@query
def search_sentences(spark, folder):
    themes = two.themes_of(D.document_themes(spark, folder), "doc_id")
    return themes.select(
        "doc_id",
        "theme_no",
        P.search_sentence(F.col("name"), F.col("description")).alias("question"),
    )


@query
def fence_strip(spark, folder):
    answers = D.turn_answers(spark, folder).select("conv_id", "turn", "response")
    return answers.select("conv_id", "turn", without_fence(F.col("response")).alias("body"))


@query
def response_parse(spark, folder):
    parsed = parsed_topics(D.turn_answers(spark, folder))
    return parsed.select(
        "conv_id",
        "turn",
        "error",
        F.array_size("topics").alias("topics_count"),
        F.get("topics", F.lit(0))["name"].alias("name"),
        F.get("topics", F.lit(0))["description"].alias("description"),
        F.get("topics", F.lit(0))["importance"].alias("importance"),
    )


@query
def response_errors(spark, folder):
    return U.failure_counts(parsed_topics(D.turn_answers(spark, folder)))


@query
def completion_calls(spark, folder):
    """A caller's function that fails on some prompts, run on every turn."""

    def respond(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("refused")
        return '{"topics": [{"name": "n", "description": "%d"}]}' % len(prompt)

    turns = D.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    parsed = parsed_topics(complete(turns, respond, "text"))
    return parsed.select(
        "conv_id",
        "turn",
        "error",
        F.get("topics", F.lit(0))["description"].alias("description"),
    )


# --- terms -------------------------------------------------------------------


def _document_terms(spark, folder):
    docs = D.table(spark, folder, "documents").select("doc_id", "text")
    return V.with_terms(docs, "text").select("doc_id", "terms")


@query
def term_counts(spark, folder):
    return V.term_counts(_document_terms(spark, folder), ["doc_id"])


@query
def bigrams(spark, folder):
    docs = D.table(spark, folder, "documents").select("doc_id", "text")
    pairs = V.with_terms(docs, "text").select(T.bigrams(F.col("terms")).alias("terms"))
    return V.term_statistics(pairs)


@query
def vocabulary_topn(spark, folder):
    statistics = V.term_statistics(_document_terms(spark, folder))
    return V.vocabulary(statistics, Settings().article_terms)


@query
def tfidf_within_article(spark, folder):
    vectors = one.topic_vectors(D.turn_topics(spark, folder), "conv_id", Settings())
    long = V.long_vectors(vectors, ["conv_id", "topic_no"])
    return long.withColumn("w", F.round("w", 6))


@query
def tfidf_corpus(spark, folder):
    texts = written(_document_terms(spark, folder))
    vectors = V.tfidf_vectors(texts, ["doc_id"], Settings().article_terms, pairs=True)
    return V.long_vectors(vectors, ["doc_id"]).withColumn("w", F.round("w", 6))


# --- topics inside an article ------------------------------------------------


def _pairs(spark, folder, threshold):
    s = Settings()
    vectors = one.topic_vectors(D.turn_topics(spark, folder), "conv_id", s)
    found = G.prefix_pairs(vectors, ["conv_id"], "topic_no", threshold)
    return found.withColumn("sim", F.round("sim", 6))


@query
def topic_copies(spark, folder):
    """Every topic with the representative of its equal vectors, and their number."""
    s = Settings()
    vectors = one.topic_vectors(D.turn_topics(spark, folder), "conv_id", s)
    return G.copies(vectors, ["conv_id"], "topic_no")


@query
def topic_similarity_pairs(spark, folder):
    return _pairs(spark, folder, Settings().similarity_threshold)


@query
def topic_similarity_pairs_loose(spark, folder):
    return _pairs(spark, folder, LOOSE)


def _leaders(spark, folder, threshold):
    s = Settings()
    topics = D.turn_topics(spark, folder)
    later = G.has_later_blocks(topics, "topic_no", s.block_rows)
    vectors = one.topic_vectors(topics, "conv_id", s)
    found = G.topic_leaders(vectors, ["conv_id"], "topic_no", threshold, later, s.block_rows)
    return found.withColumn("sim", F.round("sim", 6))


@query
def topic_leaders(spark, folder):
    return _leaders(spark, folder, Settings().similarity_threshold)


@query
def topic_leaders_loose(spark, folder):
    return _leaders(spark, folder, LOOSE)


def _flat_merged(merged):
    return merged.select(
        "conv_id",
        "leader_no",
        "part_no",
        "name",
        "description",
        joined("key_phrases").alias("key_phrases"),
        "importance",
        joined("supporting_quotes").alias("supporting_quotes"),
        joined("merged_from").alias("merged_from"),
        "cluster_size",
    )


@query
def merged_topics(spark, folder):
    topics = D.turn_topics(spark, folder)
    return _flat_merged(one.merged_topics(topics, "conv_id", Settings()))


@query
def merged_topics_loose(spark, folder):
    topics = D.turn_topics(spark, folder)
    settings = Settings(similarity_threshold=LOOSE)
    return _flat_merged(one.merged_topics(topics, "conv_id", settings))


def _records(spark, folder):
    return one.records_of(
        D.conversations(spark, folder),
        D.readable_turn_topics(spark, folder),
        "conv_id",
        Settings(similarity_threshold=LOOSE),
    )


@query
def stage1_records(spark, folder):
    return _records(spark, folder).select(
        "conv_id",
        "word_count",
        "error",
        "part_no",
        joined(F.col("original_topics.name")).alias("original_names"),
        joined(F.col("clustered_topics.name")).alias("clustered_names"),
        "topics_count",
        "clustered_count",
        "reduction_ratio",
    )


@query
def stage1_summary(spark, folder):
    return U.stage1_summary(_records(spark, folder))


@query
def successful_articles(spark, folder):
    found = U.successful_records(_records(spark, folder))
    return found.select("conv_id", "clustered_count")


@query
def builtin_topics(spark, folder):
    """The built-in topic answers read back through the answer parser."""
    turns = D.table(spark, folder, "conversations")
    answers = B.topic_answers(turns, "conv_id", "turn", "text", Settings().max_topics)
    topics = one.topics_of(parsed_topics(answers), "conv_id")
    return topics.select(
        "conv_id",
        "topic_no",
        "name",
        "description",
        joined("key_phrases").alias("key_phrases"),
        "importance",
        joined("supporting_quotes").alias("supporting_quotes"),
    )


@query
def stage1_documents(spark, folder):
    """Stage 1 from article text to records, with the built-in answers."""
    records = one.stage1(D.documents(spark, folder), "doc_id")
    return records.select(
        "doc_id",
        "filename",
        "word_count",
        "topics_count",
        "clustered_count",
        "reduction_ratio",
        "error",
    )


# --- themes and clusters -----------------------------------------------------


@query
def builtin_themes(spark, folder):
    themes = two.themes_of(two.theme_records(_records(spark, folder), "conv_id"), "conv_id")
    return themes.select(
        "conv_id",
        "theme_no",
        "name",
        "description",
        joined("related_topics").alias("related_topics"),
        "strength",
        "coverage",
    )


@query
def theme_weighting(spark, folder):
    return two.theme_texts(D.document_themes(spark, folder), "doc_id").select("doc_id", "text")


@query
def cluster_count(spark, folder):
    docs = D.table(spark, folder, "documents")
    counts = docs.groupBy("source", "lang").agg(F.count("*").alias("articles"))
    return counts.withColumn("k", S.cluster_count(F.col("articles")))


@query
def kmeans_articles(spark, folder):
    """Documents clustered by their weighted themes; numbers follow the lowest id."""
    s = Settings()
    texts = two.theme_texts(D.document_themes(spark, folder), "doc_id")
    vectors = written(two.article_vectors(texts, "doc_id", s))
    k = vectors.agg(S.cluster_count(F.count("*")).alias("k")).first()["k"]
    return KS.fit_kmeans_starts(vectors, "doc_id", "features", k, s.kmeans_seeds).assigned


def _embeddings(spark, folder):
    return D.table(spark, folder, "embeddings")


def _label_centres(spark, folder):
    # one row per label
    found = C.centroids(_embeddings(spark, folder), "label", "embedding").collect()
    return {r["label"]: list(r["centre"]) for r in found}


@query
def centroids(spark, folder):
    found = C.centroids(_embeddings(spark, folder), "label", "embedding")
    return found.select("label", F.posexplode("centre").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def nearest_centroid(spark, folder):
    centres = _label_centres(spark, folder)
    found = C.nearest_centre(_embeddings(spark, folder), "embedding", centres)
    return found.select(
        "vec_id",
        F.col("nearest.cluster_number").alias("cluster_number"),
        F.round("nearest.squared_distance", 6).alias("squared_distance"),
    )


@query
def inertia(spark, folder):
    centres = _label_centres(spark, folder)
    found = C.nearest_centre(_embeddings(spark, folder), "embedding", centres)
    return C.inertia(found).withColumn("inertia", F.round("inertia", 6))


@query
def silhouette_by_point(spark, folder):
    found = silhouette_points(_embeddings(spark, folder), "vec_id", "label", "embedding")
    return found.withColumn("score", F.round("score", 6))


@query
def silhouette_score(spark, folder):
    return silhouette(_embeddings(spark, folder), "vec_id", "label", "embedding")


@query
def cluster_members(spark, folder):
    return C.cluster_members(_embeddings(spark, folder), "vec_id", "label")


@query
def cluster_themes_top20(spark, folder):
    themes = _cluster_themes(D.document_themes(spark, folder))
    shown = C.shown_themes(themes, "doc_id", Settings().shown_themes)
    return shown.select("cluster_number", "shown_no", "doc_id", "theme_no", "name", "description")


@query
def cluster_theme_counts(spark, folder):
    found = C.cluster_theme_counts(_cluster_themes(D.document_themes(spark, folder)))
    return found.withColumn("mean_strength", F.round("mean_strength", 6))


@query
def builtin_cluster_analysis(spark, folder):
    rows = D.document_themes(spark, folder)
    themes, sizes = _cluster_themes(rows), C.cluster_sizes(rows)
    found = two.cluster_analysis(themes, sizes, "doc_id", Settings(), None)
    return found.select(
        "cluster_id",
        "cluster_number",
        "size",
        "cluster_name",
        "main_theme",
        joined("common_patterns").alias("common_patterns"),
        joined("distinguishing_features").alias("distinguishing_features"),
        "cluster_summary",
        "articles_count",
        "themes_analyzed",
        "display_name",
        "display_theme",
        "error",
    )


@query
def cluster_fallback_names(spark, folder):
    """Clusters joined to answers of which some could not be read."""
    rows = D.document_themes(spark, folder)
    themes, sizes = _cluster_themes(rows), C.cluster_sizes(rows)
    answers = B.cluster_answers(themes).where(F.col("cluster_number") % 2 == 0)
    parsed = parsed_answers(answers, fixed.CLUSTER_ANSWER)
    return C.with_analysis(sizes, parsed).select(
        "cluster_number", "size", "display_name", "display_theme"
    )


@query
def first_match_lookup(spark, folder):
    """Each document with the first document of its source."""
    docs = D.table(spark, folder, "documents")
    records = docs.select("source", F.col("doc_id").alias("first_id"), F.col("lang").alias("first_lang"))
    return C.first_match(docs.select("doc_id", "source"), records, "source", "first_id")


@query
def stage2_summary(spark, folder):
    rows = D.document_themes(spark, folder, failures=True)
    points = silhouette(_embeddings(spark, folder), "vec_id", "label", "embedding").first()
    return U.stage2_summary(
        U.stage1_summary(_records(spark, folder)),
        rows,
        "doc_id",
        points["clusters"],
        points["silhouette_score"],
    )


@query
def stage2_conversations(spark, folder):
    """Both stages on the conversations, ending in the described clusters."""
    records = written(_records(spark, folder))
    found = two.stage2(records, "conv_id")
    return found.clusters.select(
        "cluster_id", "size", "display_name", "display_theme", "themes_analyzed"
    )


# --- retrieval ---------------------------------------------------------------


def _chunks(spark, folder):
    docs = D.table(spark, folder, "documents")
    return R.chunks(docs, "doc_id", "text", CHUNK, OVERLAP)


@query
def chunks(spark, folder):
    return _chunks(spark, folder)


@query
def chunk_vectors(spark, folder):
    found = R.chunk_vectors(_chunks(spark, folder), "doc_id", Settings().embedding_dim)
    return found.select("doc_id", "chunk_no", joined(F.col("embedding").cast("array<int>")).alias("v"))


@query
def vector_topk(spark, folder):
    """The label centres as questions over all vectors."""
    centres = _label_centres(spark, folder)
    questions = [(str(label), centre) for label, centre in sorted(centres.items())]
    found = R.vector_topk(_embeddings(spark, folder), ["vec_id"], "embedding", questions, K)
    return found.withColumn("score", F.round("score", 6))


@query
def vector_index_topk(spark, folder):
    """Every vector whose id is divisible by 50 asks for its K nearest by cosine, found
    through the bucketed index, exact."""
    vectors = _embeddings(spark, folder)
    index = X.build_index(vectors, ["vec_id"], "embedding")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(
        F.col("vec_id").cast("string").alias("question_id"), F.col("embedding").alias("vector")
    )
    found = X.search(index, asked, K)
    return found.select(F.col("question_id").alias("query_id"), "vec_id", F.round("score", 6).alias("score"), "rank")


def _key_terms(spark, folder):
    return R.key_terms(_chunks(spark, folder), "doc_id", Settings().chunk_key_terms)


@query
def chunk_key_terms(spark, folder):
    return _key_terms(spark, folder).withColumn("terms", joined("terms"))


@query
def term_graph_nodes(spark, folder):
    return R.graph_nodes(_key_terms(spark, folder))


@query
def term_graph(spark, folder):
    return R.graph_edges(_key_terms(spark, folder))


def _graph(spark, folder):
    keyed = written(_key_terms(spark, folder))
    return keyed, written(R.graph_edges(keyed))


def _local(keyed, edges):
    return R.retrieve_local(keyed, edges, QUESTION, "doc_id", Settings().neighbours, K)


def _global(keyed, edges):
    return R.retrieve_global(keyed, edges, QUESTION, "doc_id", K)


@query
def retrieve_local(spark, folder):
    return _local(*_graph(spark, folder))


@query
def retrieve_global(spark, folder):
    return _global(*_graph(spark, folder))


def _store(spark, folder):
    """All documents inserted into a new term store in the shared folder."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    settings = Settings(chunk_words=CHUNK, chunk_overlap=OVERLAP)
    TS.insert(D.table(spark, folder, "documents"), "doc_id", "text", path, settings)
    return path


@query
def term_store_local(spark, folder):
    """The local search over the store: postings and edges of the question's buckets."""
    found = TS.local(spark, _store(spark, folder), QUESTION, Settings().neighbours, K)
    return found.select(F.col("key").alias("doc_id"), "chunk_no", "score", "rank")


@query
def term_store_global(spark, folder):
    found = TS.global_(spark, _store(spark, folder), QUESTION, K)
    return found.select(F.col("key").alias("doc_id"), "chunk_no", "score", "rank")


@query
def retrieve_hybrid(spark, folder):
    graph = _graph(spark, folder)
    return R.retrieve_hybrid([_local(*graph), _global(*graph)], "doc_id", K)


# --- totals ------------------------------------------------------------------


def _with_failures(spark, folder):
    error = F.when(F.col("doc_id") % 19 == 18, F.concat(F.lit("cannot read "), "lang"))
    return (
        D.documents(spark, folder)
        .join(D.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
        .withColumn("error", error)
    )


@query
def corpus_totals(spark, folder):
    return U.corpus_totals(_with_failures(spark, folder))


@query
def failure_counts(spark, folder):
    return U.failure_counts(_with_failures(spark, folder))
