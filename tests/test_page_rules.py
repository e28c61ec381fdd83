"""Edge pages, text measures against a word-by-word count."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import html as H
from lurescan.functions import text as T
from lurescan.operators import page_features as P

PAGES = {
    1: (
        "http://host.com/",
        '<html><head><title> T &amp; T </title></head><body onload="x()">'
        '<input><input type=password><input type="FILE"><div class="search-box" id=Comments>c</div>'
        '<a href="http://host.com/a">i</a><a href=\'https://facebook.com/x\'>o</a><a href="/r">r</a>'
        '<img src="http://cdn.org/i.png" srcset="x"><script src="https://cdn.org/s.js"></script>'
        '<b onmouseover="a>b" onclick=go()>x</b><time>1</time><p datetime>2</p>'
        '<meta name="viewport"><link rel="stylesheet" href="/mobile.css"></body></html>',
    ),
    2: ("http://host.com/2", "<body>The table is red. It is good.</body>"),
    3: ("http://host.com/3", ""),
    4: ("http://host.com/4", "<body>A terror show in the park today with many people and dogs</body>"),
    5: ("http://host.com/5", '<body><!-- <div> --><script>var a="<div>";</script><style>@media x{}</style></body>'),
    6: ("http://host.com/6", "<body>&lt;b&gt; &#65;&#x42; &copy; &nope; &amp;lt; a & b</body>"),
    7: ("http://host.com/7", "<p>no body</p><b>x < y"),
    8: ("http://host.com/8", '<body><form></form><input type="a"><input type="b"><select></select><textarea>t</textarea></body>'),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, h) for k, (u, h) in PAGES.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r for r in P.page_features_raw(df, 2024).collect()}


EXPECTED = [
    (1, "title", "T & T"),
    (1, "nb_input_types", 3),
    (1, "has_password_field", 1),
    (1, "has_login_form", 1),
    (1, "has_file_upload", 1),
    (1, "has_search_box", 1),
    (1, "has_comment_sections", 0),
    (1, "form_complexity", 3.0),
    (1, "nb_ext_links", 1),
    (1, "nb_ext_imgs", 1),
    (1, "nb_ext_scripts", 1),
    (1, "nb_social_media_links", 1),
    (1, "has_onclick", 1),
    (1, "has_onmouse", 1),
    (1, "has_onload", 1),
    (1, "has_date_stamps", 2),
    (1, "has_responsive_imgs", 1),
    (1, "has_view_port_meta", 1),
    (1, "has_mobile_css", 1),
    (2, "avg_sentence_len", 3.5),
    (2, "readability_score", 106.6),
    (2, "body_text", "The table is red. It is good."),
    (3, "unique_words_ratio", 0.0),
    (3, "punctuation_density", None),
    (3, "avg_paragraph_len", 0.0),
    (3, "is_empty_title", 1),
    (4, "is_alive", 0),
    (5, "nb_divs", 0),
    (5, "script_len", 14),
    (5, "has_mobile_css", 1),
    (5, "body_text", 'var a="<div>";@media x{}'),
    (6, "body_text", "<b> AB © &nope; &lt; a & b"),
    (7, "body_text", "no bodyx < y"),
    (8, "nb_input_types", 2),
    (8, "form_complexity", 4.0),
    (8, "body_text", "t"),
]


@pytest.mark.parametrize("page,column,expected", EXPECTED)
def test_edge_page(pages, page, column, expected):
    assert pages[page][column] == expected


def test_dead_page_gets_defaults(spark):
    rows = [(k, u, h) for k, (u, h) in PAGES.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dead = P.page_features(df, 2024).filter("page_id = 4").first()
    assert all(dead[c] == (1 if c == "is_empty_title" else 0) for c in C.PAGE_FEATURE_COLUMNS)
    assert dead["error_reason"]


def test_status_code_marks_dead(spark):
    df = spark.createDataFrame(
        [(1, "http://a/", "<body>fine</body>", 404), (2, "http://b/", "<body>fine</body>", 200)],
        "page_id long, url string, html string, status_code int",
    )
    rows = P.page_features_raw(df, 2024).collect()
    assert {r["page_id"]: r["is_alive"] for r in rows} == {1: 0, 2: 1}


def test_elements_map_keeps_first_attribute(spark):
    df = spark.createDataFrame([(1, 'u', '<A Href="1" href="2" x>t</a><br/>')], "page_id long, url string, html string")
    rows = P.page_elements(df).orderBy("pos").collect()
    assert [(r["tag"], r["attrs"]) for r in rows] == [("a", {"href": "1", "x": ""}), ("br", {})]


def syllables(word):
    w = re.sub("[^a-z]", "", word.lower())
    if not w:
        return 0
    if len(w) <= 3:
        return 1
    groups = len(re.findall("[aeiouy]+", w))
    n = groups - (w.endswith("e") and groups > 1) + bool(re.search("[^aeiouy]le$", w))
    return max(1, n)


def test_counts_equal_word_by_word(spark):
    rng = random.Random(11)
    letters = "aeiouyblestrkmé1.,!?-'  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["table cake the 123 agree tree rhythm apple", "...", " a b\tc\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    clean = df.withColumn("clean", T.squeeze(T.plain_spaces(F.col("t"))))
    rows = T.with_readability(
        clean.withColumn("kept", T.sentences(F.col("clean"))), "clean", "kept"
    ).collect()
    for row in rows:
        squeezed = re.sub(r"\s+", " ", texts[row["id"]]).strip(" ")
        words = [w for w in squeezed.split(" ") if re.search("[a-zA-Z0-9]", w)]
        kept = [
            s for s in re.split(r"[.!?]+\s+|[.!?]+$", squeezed)
            if len(s.strip()) >= 3 and re.search("[a-zA-Z]", s)
        ]
        inside = sum(1 for s in kept for w in s.strip().split() if re.search("[a-zA-Z0-9]", w))
        assert row["n_words"] == len(words), row
        assert row["n_sentences"] == len(kept), row
        assert row["n_syllables"] == sum(syllables(w) for w in words), row
        assert abs(row["avg_sentence_len"] - (inside / len(kept) if kept else 0)) < 1e-9, row


def test_syllables_of_words(spark):
    words = ["table", "cake", "the", "123", "agree", "rhythm", "Apple!", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = [r[0] for r in df.select(T.syllables_of_word(F.col("w"))).collect()]
    assert found == [syllables(w) for w in words]


def test_long_attribute_does_not_overflow(spark):
    html = "<body><div data-x='" + "y" * 300_000 + "'>t</div>" + "<p>" * 20_000 + "</body>"
    df = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    row = P.page_features_raw(df, 2024).first()
    assert row["nb_divs"] == 1 and row["nb_paragraphs"] == 20_000


def test_decode_every_kind_of_reference(spark):
    df = spark.createDataFrame([("&hearts;&#128512;&#x1F600;&#0;&#xD800;&;&#;",)], "t string")
    assert df.select(H.decode_entities(F.col("t"))).first()[0] == "♥😀😀��&;&#;"


def test_candidates(spark):
    requests = spark.createDataFrame([(1, "a.com"), (2, "http://b.com"), (3, "c.com")], "id int, asked string")
    snapshot = spark.createDataFrame(
        [("http://a.com", 1), ("https://a.com", 0), ("http://b.com", 1)], "url string, is_alive int"
    )
    rows = P.first_alive_candidate(requests, snapshot, "id", "asked").collect()
    assert {r["id"]: r["candidate"] for r in rows} == {1: "http://a.com", 2: "http://b.com", 3: None}
