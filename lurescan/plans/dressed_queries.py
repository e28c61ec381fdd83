"""Element flags over pages into which forms, handlers, images and the like are written by a hash."""

from pyspark.sql import functions as F

from lurescan.operators import page_features as P
from lurescan.plans import page_queries
from lurescan.plans.registry import COLUMNS, ORACLES, Tables, query

PIECES = [
    '<form><input name="u"><input type="password"><input type="file"><select></select></form>',
    '<form><input type="search"><textarea></textarea></form><div onclick="x()" onmouseover="y()">a</div>',
    '<img src="http://other.org/i.png" srcset="a 2x"><script src="https://cdn.other.org/x.js"></script><div onload="z()">b</div>',
    '<a href="https://www.facebook.com/p">f</a><a href="http://ext.example.edu/">e</a><span class="share-twitter">s</span>',
    '<time datetime="2024-01-01">d</time><span class="badge new">n</span><div id="captcha">c</div>',
    '<div class="comment">c</div><div class="star-rating">r</div><div class="search">q</div>',
    '<picture></picture><meta name="viewport" content="w"><style>@media (max-width:1px){}</style>',
    '<div class="banner">b</div><div id="ad">i</div><link rel="stylesheet" href="mobile.css">',
]

DRESSED_SQL = "dressed AS (SELECT page_id, url, replace(html, '</article>', {pieces} || '</article>') AS html FROM pages),\npages AS (SELECT * FROM dressed)".format(
    pieces=" || ".join(
        f"CASE WHEN substr(md5(CAST(page_id AS VARCHAR)), {k + 1}, 1) < '8' THEN '{p}' ELSE '' END" for k, p in enumerate(PIECES)
    )
)


def dressed(t: Tables):
    code = F.md5(F.col("page_id").cast("string"))
    pieces = [F.when(F.substring(code, k + 1, 1) < "8", p).otherwise("") for k, p in enumerate(PIECES)]
    return t.pages.withColumn("html", F.replace("html", F.lit("</article>"), F.concat(*pieces, F.lit("</article>"))))


def over_dressed(name: str) -> str:
    return f"WITH {DRESSED_SQL}\nSELECT * FROM ({ORACLES[name]}) AS inner_result"


@query("dressed_element_flags", COLUMNS["page_element_flags"], over_dressed("page_element_flags"))
def dressed_element_flags(t: Tables):
    return P.page_features_raw(dressed(t), page_queries.AS_OF_YEAR)


@query("dressed_tag_counts", COLUMNS["page_tag_counts"], over_dressed("page_tag_counts"))
def dressed_tag_counts(t: Tables):
    return P.page_features_raw(dressed(t), page_queries.AS_OF_YEAR)
