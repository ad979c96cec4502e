"""Both jobs as queries: run twice into a new folder, and the output as it then stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import pair_scores, text_study
from pairloom.plans.catalog import query
from pairloom.plans.dependence_queries import MI, rho_sql, z_sql
from pairloom.plans.pair_queries import ONE, THREE_WAY
from pairloom.sources.scratch import lasting


@query(f"""WITH {ONE}, h AS (SELECT {THREE_WAY} AS pair_class, similarity AS score, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT pair_class, score, n, CAST(sum(n) OVER (PARTITION BY pair_class ORDER BY score DESC) AS DOUBLE) / sum(n) OVER (PARTITION BY pair_class) AS rate FROM h""")
def job1_pair_scores(spark, sf_dir):
    """The second run finds nothing new and leaves the report as it was."""
    folder = lasting(spark)
    for _ in range(2):
        out = pair_scores.run(spark, f"{sf_dir}/embeddings.parquet*", f"{folder}/scores", f"{folder}/checkpoint")
    return out.select("pair_class", "score", "n", "rate")


def _measures_sql() -> str:
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    words = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
    n, chars = f"CAST(len({words}) AS DOUBLE)", "CAST(length(text) AS DOUBLE)"
    shown = {"chars": chars, "words": n, "lines": f"{count(chr(92) + 'n')} + 1", "word_length": rf"({chars} - {count('[' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')}) / {n}"}
    shown |= {"digits": f"{count('[0-9]')} / {chars}", "capitals": f"{count('[A-Z]')} / {chars}", "marks": count(r"[!-/:-@\[-`{-~]") + f" / {chars}", "distinct": f"len(list_distinct({words})) / {n}"}
    return ", ".join(f"CAST({shown[m]} AS DOUBLE) AS \"{m}\"" for m in text_study.MEASURES)


_LISTED = " UNION ALL ".join(f"SELECT lang, doc_id AS person, ln(chars + 1) AS size, {k} AS position, \"{m}\" AS value FROM kept" for k, m in enumerate(text_study.MEASURES))
_NAMES = "[" + ", ".join(f"'{m}'" for m in text_study.MEASURES) + "]"


@query(rf"""WITH one AS (SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY 1),
    f AS (SELECT doc_id, lang, {_measures_sql()} FROM one),
    kept AS (SELECT * FROM f WHERE lang IN (SELECT lang FROM f GROUP BY 1 HAVING count(*) >= 10)),
    m AS MATERIALIZED ({_LISTED}),
    fit AS (SELECT lang, position, regr_slope(value, size) AS b, regr_intercept(value, size) AS a FROM m GROUP BY 1, 2),
    v AS MATERIALIZED (SELECT 'raw' AS version, lang, person, position, value FROM m UNION ALL SELECT 'adjusted', lang, person, position, round(value - a - b * size, 9) FROM m JOIN fit USING (lang, position)),
    z AS MATERIALIZED {z_sql('v', 'version, lang, position')}
    SELECT {_NAMES}[pa + 1] AS a, {_NAMES}[pb + 1] AS b, (SELECT count(*) FROM kept k WHERE k.lang = r.lang) AS n, round(rho, 4) AS rho, round({MI}, 4) AS mi, version, lang FROM {rho_sql('z', ['version', 'lang'])} r""")
def job2_text_study(spark, sf_dir):
    """The second run replaces what the first one wrote with the same."""
    folder = lasting(spark)
    for _ in range(2):
        out = text_study.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/study")
    return out.withColumns({c: F.round(c, 4) for c in ("rho", "mi")})
