"""Tokens, vectors, sequences, splits and samples."""

from pyspark.sql import functions as F

from lurescan.operators import sampling as S
from lurescan.operators import tokens as H
from lurescan.plans.dataset_queries import hash_number, hash_sql
from lurescan.plans.registry import Tables, query
from lurescan.plans.url_queries import PARTS_SQL


SALTED = "token || ':{i}'"


def tokens_sql(include_scheme: bool) -> str:
    scheme = "[lower(scheme)] || " if include_scheme else ""
    return rf"""
    tokenised AS (
      SELECT page_id, url, scheme,
        list_transform(list_filter({scheme}string_split(lower(netloc), '.') || string_split(lower(path), '/') || string_split(lower(query), '&'),
          lambda x: x <> ''), lambda x: regexp_replace(x, '[^a-z0-9\-/.=]', '', 'g')) AS tokens
      FROM parts)"""


def tokenised(t: Tables, include_scheme: bool = False):
    return t.pages.select("page_id", "url").withColumn(
        "tokens", H.url_tokens(F.col("url"), include_scheme)
    )


@query(
    "url_tokens",
    "page_id:i training:s serving:s first_four:s",
    f"""WITH {PARTS_SQL}, {tokens_sql(False)}
    SELECT page_id, scheme || ' ' || array_to_string(tokens, ' ') AS training, array_to_string(tokens, ' ') AS serving,
      array_to_string((scheme || ' ' || array_to_string(tokens, ' ')).string_split(' ')[1:4], ' ') AS first_four FROM tokenised""",
)
def url_tokens(t: Tables):
    return t.pages.select(
        "page_id",
        F.array_join(H.url_tokens(F.col("url")), " ").alias("training"),
        F.array_join(H.url_tokens(F.col("url"), False), " ").alias("serving"),
        F.array_join(H.truncated(H.url_tokens(F.col("url")), 4), " ").alias("first_four"),
    )


@query(
    "url_vectors",
    "page_id:i " + " ".join(f"v{i}:d" for i in range(50)),
    f"""WITH {PARTS_SQL}, {tokens_sql(False)},
    long AS (SELECT page_id, scheme, unnest(tokens) AS token FROM tokenised),
    known AS (SELECT DISTINCT token FROM long WHERE scheme = 'https'),
    vectors AS (SELECT token, {", ".join(f"{hash_sql(SALTED.format(i=i), 1, 4)} / 65536 AS v{i}" for i in range(50))} FROM known)
    SELECT page_id, {", ".join(f"coalesce(avg(v{i}), 0) AS v{i}" for i in range(50))}
    FROM long LEFT JOIN vectors USING (token) GROUP BY page_id""",
)
def url_vectors(t: Tables):
    rows = tokenised(t)
    numbers = [hash_number(F.concat("token", F.lit(f":{i}")), 1, 4) / 65536 for i in range(H.VECTOR_SIZE)]
    vectors = (
        rows.filter(F.col("url").startswith("https:"))
        .select(F.explode("tokens").alias("token"))
        .distinct()
        .withColumn("vector", F.array(*numbers))
    )
    found = H.url_vectors(rows, vectors, "page_id")
    return found.select("page_id", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(H.VECTOR_SIZE)])


@query("word2vec_url_vectors", "page_id:i size:i norm:d")
def word2vec_url_vectors(t: Tables):
    rows = tokenised(t, True)
    model = H.word2vec_fit(rows)
    found = H.url_vectors(rows, H.vectors_of(model), "page_id")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    return found.select("page_id", F.size("vector").alias("size"), F.sqrt(squares).alias("norm"))


VOCABULARY_SQL = r"""
chars AS (SELECT unnest(string_split(regexp_replace(lower(url), '\s+', '', 'g'), '')) AS ch FROM pages),
vocabulary AS (SELECT ch AS char, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ch) AS id FROM chars GROUP BY ch)
"""


@query("char_vocabulary", "char:s n:i id:i", f"WITH {VOCABULARY_SQL} SELECT * FROM vocabulary")
def char_vocabulary(t: Tables):
    return H.char_vocabulary(t.pages)


@query(
    "char_sequences",
    "page_id:i sequence:s",
    f"""WITH {VOCABULARY_SQL},
    placed AS (SELECT page_id, unnest(string_split(lower(url), '')) AS char, unnest(range(1, length(url) + 1)) AS pos FROM pages),
    listed AS (SELECT page_id, list(id ORDER BY pos) AS ids FROM placed JOIN vocabulary USING (char) GROUP BY page_id)
    SELECT page_id, array_to_string((ids || list_transform(range(200), lambda x: 0))[1:200], ' ') AS sequence FROM listed""",
)
def char_sequences(t: Tables):
    rows = H.char_sequences(t.pages.select("page_id", "url"), H.char_vocabulary(t.pages))
    return rows.withColumn("sequence", F.array_join(F.col("sequence").cast("array<string>"), " "))


@query(
    "chat_examples",
    "page_id:i n_messages:i roles:s user_text:s answer:s",
    """SELECT page_id, 3 AS n_messages, 'system user assistant' AS roles,
      'Classify the following URL:' || chr(10) || url AS user_text,
      CASE WHEN starts_with(url, 'https') THEN 'benign' ELSE 'phishing' END AS answer FROM pages""",
)
def chat_examples(t: Tables):
    rows = H.chat_examples(
        t.pages.select("page_id", "url", F.col("url").startswith("https").cast("int").alias("label"))
    )
    messages = F.col("messages")
    return rows.select(
        "page_id",
        F.size(messages).alias("n_messages"),
        F.array_join(messages["role"], " ").alias("roles"),
        messages[1]["content"].alias("user_text"),
        messages[2]["content"].alias("answer"),
    )


# --- splits and samples: labels by document, embeddings with ten classes --------------------------

LABELS_SQL = "rows_of AS (SELECT doc_id, quality AS label, md5(doc_id || ':42') AS h FROM labels)"
VECTORS_SQL = "rows_of AS (SELECT vec_id, label, md5(vec_id || ':42') AS h FROM embeddings)"


def labels(t: Tables):
    return t.labels.select("doc_id", F.col("quality").alias("label"))


def vectors(t: Tables):
    return t.embeddings.select("vec_id", "label")


@query(
    "stratified_split",
    "doc_id:i label:i split:s",
    f"""WITH {LABELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn,
      count(*) OVER (PARTITION BY label) AS n FROM rows_of)
    SELECT doc_id, label, CASE WHEN rn <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def stratified_split(t: Tables):
    return S.stratified_split(labels(t), "doc_id")


@query(
    "random_split",
    "vec_id:i split:s",
    f"""WITH {VECTORS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM rows_of)
    SELECT vec_id, CASE WHEN rn <= floor(0.1 * n + 0.5) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def random_split(t: Tables):
    return S.random_split(vectors(t), "vec_id")


@query(
    "shuffled_rows",
    "doc_id:i label:i position:i",
    f"WITH {LABELS_SQL} SELECT doc_id, label, row_number() OVER (ORDER BY h) AS position FROM rows_of",
)
def shuffled_rows(t: Tables):
    return S.shuffled_positions(labels(t), "doc_id")


@query(
    "sample_exactly",
    "doc_id:i label:i",
    f"WITH {LABELS_SQL} SELECT doc_id, label FROM rows_of ORDER BY h LIMIT 50",
)
def sample_exactly(t: Tables):
    return S.sample_exactly(labels(t), "doc_id", 50)


_PER_CLASS_SQL = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM rows_of)"


@query(
    "sample_per_class",
    "vec_id:i label:i",
    f"WITH {VECTORS_SQL} SELECT vec_id, label FROM {_PER_CLASS_SQL} WHERE rn <= 20",
)
def sample_per_class(t: Tables):
    return S.sample_per_class(vectors(t), "vec_id", 20)


@query(
    "sample_up_to",
    "doc_id:i label:i",
    f"WITH {LABELS_SQL} SELECT doc_id, label FROM {_PER_CLASS_SQL} WHERE rn <= 100",
)
def sample_up_to(t: Tables):
    return S.sample_up_to(labels(t), "doc_id", 100)


@query(
    "second_sample",
    "vec_id:i label:i",
    f"WITH {VECTORS_SQL} SELECT vec_id, label FROM {_PER_CLASS_SQL} WHERE rn > 10 AND rn <= 25",
)
def second_sample(t: Tables):
    rows = vectors(t)
    return S.second_sample(rows, S.sample_per_class(rows, "vec_id", 10), "vec_id", 15)


@query(
    "last_rows_split",
    "o_orderkey:i split:s",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 >= floor((SELECT count(*) FROM orders) * (1 - 0.15))
      THEN 'validation' ELSE 'train' END AS split FROM orders""",
)
def last_rows_split(t: Tables):
    return S.last_rows_split(t.orders, "o_orderkey")


@query(
    "row_range",
    "o_orderkey:i row_idx:i",
    """SELECT * FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)
    WHERE row_idx >= 200 AND row_idx < (SELECT count(*) FROM orders) - 100""",
)
def row_range(t: Tables):
    return S.row_range(t.orders, "o_orderkey", 200, t.orders.count() - 100)


@query(
    "class_weights",
    "label:i n:i weight:d",
    """SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)) AS weight
    FROM embeddings GROUP BY label""",
)
def class_weights(t: Tables):
    return S.class_weights(t.embeddings)


@query(
    "with_class_weight",
    "vec_id:i weight:d",
    """WITH w AS (SELECT label, (SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)) AS weight
      FROM embeddings GROUP BY label) SELECT vec_id, weight FROM embeddings JOIN w USING (label)""",
)
def with_class_weight(t: Tables):
    return S.with_class_weight(vectors(t))


@query(
    "sample_composition",
    "sample:s total:i benign:i phishing:i",
    """SELECT d.source AS sample, count(*) AS total, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS benign,
      sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS phishing
    FROM labels JOIN documents d USING (doc_id) GROUP BY d.source""",
)
def sample_composition(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return S.sample_composition(
        rows.select(F.col("source").alias("sample"), F.col("quality").alias("label"))
    )
