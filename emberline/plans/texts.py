"""Rules of texts over the tables' own texts: references, domains, leads, summaries, dates, hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts as O
from ..sources import views as V
from .catalog import query

QUOTED = r'“[^”]*”|「[^」]*」|"[^"]*"'
LOOSE = r"\b(he|she|it|they|this|that|there)\b"


@query("x37_text_references", f"SELECT conv_id, turn, list_filter(t, lambda x, i: list_position(t, x) = i) AS tokens FROM (SELECT conv_id, turn, regexp_extract_all(lower(regexp_replace(text, '{QUOTED}', ' ', 'g')), '{LOOSE}', 1) AS t FROM conversations)", lists=("tokens",))
def x37_texts(spark, d):
    """Pronouns and pointers of each turn outside of quotes, each once, in their order."""
    c = V.read(spark, d, "conversations")
    plain = F.lower(F.regexp_replace("text", QUOTED, " "))
    return c.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(plain, F.lit(LOOSE), F.lit(1))).alias("tokens"))


#: Words of a text's language, by which records find their domain.
WORDS = {"english": ["the ", " and ", "that "], "german": [" der ", " und ", "ung "], "french": [" les ", " des ", "que "], "spanish": [" los ", " que ", "ción "]}
SQL_HITS = ", ".join("{'n': -(" + " + ".join(f"contains(lower(content), '{w}')::INT" for w in words) + f"), 'k': {k}, 'name': '{name}'}}" for k, (name, words) in enumerate(WORDS.items()))


@query("x28_text_domains", f"SELECT id, CASE WHEN len(g) > 0 THEN list_transform(g, lambda x: x.name) ELSE domain END AS domains FROM (SELECT id, domain, list_sort(list_filter([{SQL_HITS}], lambda x: x.n <= -2))[1:2] AS g FROM memories)", ("memories",), ("domains",))
def x28_texts(spark, d):
    return V.memories(spark, d).select("id", O.classified(F.col("content"), WORDS, F.col("domain")).alias("domains"))


@query("x05_text_leads", r"""WITH l AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^\s*(?:---|——.*——|\[[^\]]*\]|[#>*\-|]+)\s*$')) AS lines FROM memories)
SELECT id, list_filter(list_transform(lines, lambda x: coalesce(nullif(trim(regexp_extract(x, '[^。！？!?；;\n]{4,24}'), ' '), ''), CASE WHEN length(x) >= 4 THEN left(x, 24) END)), lambda x: x IS NOT NULL)[1:1] AS lead FROM l""", ("memories",), ("lead",))
def x05_texts(spark, d):
    return V.memories(spark, d).select("id", X.body_lead(F.col("content")).alias("lead"))


@query("x42_text_summaries", r"SELECT conv_id, turn, left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 'none'), 80) AS summary FROM conversations WHERE NOT regexp_matches(text, '^\s*\{|\[\[|!\[')")
def x42_texts(spark, d):
    c = V.read(spark, d, "conversations").filter(~F.col("text").rlike(r"^\s*\{|\[\[|!\["))
    return c.select("conv_id", "turn", O.navigator_summary(F.col("text"), 80, "none").alias("summary"))


@query("x48_page_threads", r"""SELECT page_id, CASE WHEN t = '' OR regexp_matches(lower(t), '^(route:|auto:|session:)') OR regexp_matches(t, '^[0-9a-fA-F]{16,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') OR regexp_matches(lower(t), '^[a-z0-9]+(?:[_-][a-z0-9]+){2,}$') THEN 'other' ELSE left(t, 80) END AS thread
FROM (SELECT page_id, trim(regexp_extract(url, '([^/]*)/?$', 1), ' ') AS t FROM pages)""")
def x48_pages(spark, d):
    """The last part of a page's address as a thread's name, unless a machine made it."""
    last = F.regexp_extract("url", r"([^/]*)/?$", 1)
    return V.read(spark, d, "pages").select("page_id", O.thread_hint(last).alias("thread"))
