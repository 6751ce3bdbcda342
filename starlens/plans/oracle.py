"""The registered queries as DuckDB SQL over the same tables.

Word and rule lists come from ``fixed_values``; everything else is stated here on its own.
"""

from __future__ import annotations

import math

from starlens.functions import fixed_values as fv
from starlens.sources.testtables import PHRASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(e: str, places: int = 4) -> str:
    """Half up on the decimal digits: DuckDB rounds a DOUBLE by its binary value instead."""
    return f"CAST(CAST(CAST({e} AS DECIMAL(28, 10)) AS DECIMAL(28, {places})) AS DOUBLE)"


def pct(part: str, whole: str, places: int = 1) -> str:
    return rnd(f"100.0::DOUBLE * {part} / {whole}", places)


def fixed(e: str, places: int) -> str:
    return f"printf('%.{places}f', round(({e})::DOUBLE, {places}))"


SECOND = "'%Y-%m-%d %H:%M:%S'"


def sec(e: str) -> str:
    return f"strftime({e}, {SECOND})"


def label(e: str) -> str:
    return f"replace({e}, '_', ' ')"


# relations --------------------------------------------------------------------------------------

BASE = """base AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
reviews AS (
  SELECT CAST(event_id AS VARCHAR) AS review_id, event_type AS App, ts AS Review_Date,
    CAST(1 + k % 5 AS INTEGER) AS Star_Rating, CAST(floor(value) AS BIGINT) AS Thumbs_Up_Count,
    CASE WHEN k % 7 <> 0 THEN 'v' || CAST(k % 4 AS VARCHAR) END AS App_Version,
    CASE WHEN event_id % 4 <> 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
      (k % 5 - 2) / 2.0::DOUBLE + (event_id % 21 - 10) / 100.0::DOUBLE)) END AS Sentiment_Polarity,
    event_id, k
  FROM base)"""

_PHRASE = "CASE k % 10 " + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PHRASES)) + " END"
# white space: what splits words
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

TEXT = BASE + f""",
texted AS (
  SELECT r.*, CASE WHEN k % 25 = 24 THEN NULL WHEN k % 25 = 12 THEN '' ELSE {_PHRASE} || ' ' || d.text END AS Review_Text
  FROM reviews r LEFT JOIN documents d ON d.doc_id = r.event_id % (SELECT count(*) FROM documents)),
full_reviews AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(Review_Text, '[^{_SPACE}]+')), 0) AS INTEGER) AS Word_Count,
    CAST(coalesce(length(Review_Text), 0) AS INTEGER) AS Review_Length_Chars
  FROM texted)"""

_THEME = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(Review_Text), {lit(p)})" for p in phrases) + f" THEN {lit(name)}"
    for name, phrases in fv.THEME_RULES) + f" ELSE {lit(fv.DEFAULT_THEME)} END"
THEMED = TEXT + f",\nthemed AS (SELECT *, {_THEME} AS Review_Theme FROM texted)"

TCOUNTS = THEMED + """,
tc AS (SELECT App, Review_Theme, count(*) AS n FROM themed GROUP BY ALL)"""

_values = ", ".join(f"({lit(w)}, {p}::DOUBLE)" for p, words in fv.POLARITY_WORDS.items() for w in words)
_mods = ", ".join(f"({lit(w)}, {f}::DOUBLE)" for f, words in fv.INTENSIFIERS.items() for w in words)
_mods += ", " + ", ".join(f"({lit(w)}, {fv.NEGATION_FACTOR}::DOUBLE)" for w in fv.NEGATIONS)

SCORED = THEMED + f""",
lexicon(word, polarity) AS (VALUES {_values}),
modifier(word, factor) AS (VALUES {_mods}),
lists AS (SELECT review_id, App, regexp_extract_all(lower(Review_Text), '[a-z]+') AS words FROM texted),
token AS (SELECT review_id, App, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM lists),
paired AS (SELECT *, lag(word) OVER (PARTITION BY review_id ORDER BY i) AS prev FROM token),
hit AS (SELECT review_id, App, p.word, l.polarity * coalesce(m.factor, 1.0::DOUBLE) AS score
  FROM paired p JOIN lexicon l ON l.word = p.word LEFT JOIN modifier m ON m.word = p.prev),
score AS (SELECT review_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, avg(score))) AS polarity FROM hit GROUP BY 1)"""

_stop = ", ".join(lit(w) for w in fv.STOP_WORDS)
WORDS = TEXT + f""",
word_rows AS (
  SELECT App, CASE WHEN Star_Rating >= 4 THEN 'positive' WHEN Star_Rating <= 2 THEN 'negative' END AS polarity,
    unnest(regexp_extract_all(lower(Review_Text), '[a-z]+')) AS word FROM texted),
kc AS (SELECT App, polarity, word, count(*) AS n FROM word_rows
  WHERE polarity IS NOT NULL AND length(word) > 3 AND word NOT IN ({_stop}) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY App, polarity ORDER BY n DESC, word) AS INTEGER) AS rank FROM kc) WHERE rank <= 30),
merged AS (SELECT polarity, word, CAST(sum(n) AS BIGINT) AS n FROM top GROUP BY ALL),
cloud AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) AS INTEGER) AS rank FROM merged) WHERE rank <= 40)"""

OVERVIEW_COLS = f"""count(*) AS total_reviews, {rnd('avg(Star_Rating)')} AS avg_star,
  {rnd('avg(Sentiment_Polarity)')} AS avg_sentiment, {rnd('stddev_samp(Star_Rating)')} AS std_dev"""
OV = f",\nov AS (SELECT App, {OVERVIEW_COLS} FROM reviews GROUP BY App)"
RANKED = ",\nranked AS (SELECT CAST(row_number() OVER (ORDER BY avg_star DESC, App) AS INTEGER) AS rank, * FROM ov)"
ROLL = f""",
kr AS (SELECT coalesce(App, 'All') AS App, total_reviews, avg_star, avg_sentiment, CASE WHEN App IS NOT NULL THEN std_dev END AS std_dev
  FROM (SELECT App, {OVERVIEW_COLS} FROM reviews GROUP BY GROUPING SETS ((App), ())))"""


def top_theme_sql(where: str) -> str:
    return f"""(SELECT App, Review_Theme AS top_theme, n AS theme_reviews FROM (
      SELECT *, row_number() OVER (PARTITION BY App ORDER BY n DESC, Review_Theme) AS r FROM tc WHERE {where}) WHERE r = 1)"""


PAIN = top_theme_sql(f"Review_Theme <> {lit(fv.DEFAULT_THEME)}")
TOP = top_theme_sql("true")

SAMPLES = TEXT + """,
samples AS (SELECT App, side, rank, Star_Rating AS star, text, review_id FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY App, side ORDER BY signed NULLS LAST, Review_Date NULLS LAST, review_id) AS INTEGER) AS rank FROM (
    SELECT *, CASE Star_Rating WHEN 1 THEN 'negative' ELSE 'positive' END AS side, left(Review_Text, 200) AS text,
      CASE Star_Rating WHEN 1 THEN Sentiment_Polarity ELSE -Sentiment_Polarity END AS signed
    FROM texted WHERE Star_Rating IN (1, 5))) WHERE rank <= 5)"""

NEGATIVE = TEXT + """,
negative AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY App ORDER BY Sentiment_Polarity NULLS LAST, Review_Date, review_id) AS INTEGER) AS rank
  FROM texted WHERE Star_Rating = 1) WHERE rank <= 50)"""

SERIES = f"{rnd('avg(Sentiment_Polarity)')} AS avg_sentiment, {rnd('avg(Star_Rating)')} AS avg_star, count(Star_Rating) AS n"
DAY = "strftime(Review_Date, '%Y-%m-%d')"
DAILY = BASE + f",\ndaily AS (SELECT App, {DAY} AS day, {SERIES} FROM reviews GROUP BY ALL)"
FROM_ORDERS = """SELECT o_orderpriority AS App, o_orderdate AS Review_Date, CAST(1 + o_orderkey % 5 AS INTEGER) AS Star_Rating,
  greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (o_orderkey % 5 - 2) / 2.0::DOUBLE + (o_custkey % 21 - 10) / 100.0::DOUBLE)) AS Sentiment_Polarity FROM orders"""
MONTHLY = f"SELECT App, strftime(Review_Date, '%Y-%m') AS month, {SERIES} FROM ({FROM_ORDERS}) GROUP BY ALL"

CARDS = TCOUNTS + f""",
cards AS (SELECT o.*, s.five_star_pct, s.one_star_pct, p.top_theme AS top_pain_point, t.top_theme AS top_any FROM
  (SELECT App, {OVERVIEW_COLS} FROM reviews GROUP BY App) o
  JOIN (SELECT App, {pct("count(*) FILTER (Star_Rating = 5)", "count(*)")} AS five_star_pct,
    {pct("count(*) FILTER (Star_Rating = 1)", "count(*)")} AS one_star_pct FROM reviews GROUP BY App) s ON s.App = o.App
  LEFT JOIN {PAIN} p ON p.App = o.App LEFT JOIN {TOP} t ON t.App = o.App)"""


def side_by_side(first: str, second: str, theme: str) -> str:
    cells = [("total_reviews", "CAST(total_reviews AS VARCHAR)")]
    cells += [(m, fixed(m, 4)) for m in ("avg_star", "avg_sentiment", "std_dev", "five_star_pct", "one_star_pct")]
    cells.append(("top_pain_point", theme))
    return " UNION ALL ".join(
        f"SELECT {lit(m)} AS metric, (SELECT {e} FROM rc WHERE {first}) AS first, (SELECT {e} FROM rc WHERE {second}) AS second"
        for m, e in cells)


NUMERIC = ["Star_Rating", "Thumbs_Up_Count", "Sentiment_Polarity", "Word_Count", "Review_Length_Chars"]
COLUMNS = [("review_id", "string"), ("App", "string"), ("Review_Date", "timestamp"), ("Star_Rating", "int"),
           ("Thumbs_Up_Count", "bigint"), ("App_Version", "string"), ("Sentiment_Polarity", "double"),
           ("Review_Theme", "string"), ("Review_Text", "string"), ("Word_Count", "int"), ("Review_Length_Chars", "int")]


def column(name: str) -> str:
    return "CAST(NULL AS VARCHAR)" if name == "Review_Theme" else name


def per_column(make, names) -> str:
    return " UNION ALL ".join(make(c) for c in names)


def box(key: str, source: str, value: str) -> str:
    return f""",
v AS (SELECT {key} AS g, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
qs AS (SELECT g, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, count(*) AS n_rows FROM v GROUP BY g),
flagged AS (SELECT v.*, q25, q50, q75, n_rows, v >= q25 - 1.5 * (q75 - q25) AND v <= q75 + 1.5 * (q75 - q25) AS inside FROM v JOIN qs USING (g))
SELECT g AS "{'column' if key.startswith("'") else key}", any_value(n_rows) AS n_rows, {rnd('any_value(q25)')} AS q25, {rnd('any_value(q50)')} AS q50, {rnd('any_value(q75)')} AS q75,
  {rnd('min(v) FILTER (inside)')} AS whisker_low, {rnd('max(v) FILTER (inside)')} AS whisker_high, count(*) FILTER (NOT inside) AS outliers
FROM flagged GROUP BY g"""


def histogram(source: str, bins: int) -> str:
    """``source``: a query giving (column, value)."""
    return f"""long AS ({source}),
edges AS (SELECT "column", min(value) AS low, max(value) AS high FROM long WHERE value IS NOT NULL GROUP BY 1),
binned AS (SELECT l."column", CAST(least(CASE WHEN high > low THEN floor((value - low) / ((high - low) / {bins}.0::DOUBLE)) ELSE 0 END, {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM long l JOIN edges e ON e."column" = l."column" WHERE value IS NOT NULL GROUP BY ALL),
spine AS (SELECT *, CAST(unnest(range({bins})) AS INTEGER) AS bin FROM edges)
SELECT s."column", s.bin, {rnd(f'low + s.bin * ((high - low) / {bins}.0::DOUBLE)', 6)} AS bin_from,
  {rnd(f'low + (s.bin + 1) * ((high - low) / {bins}.0::DOUBLE)', 6)} AS bin_to, coalesce(n, 0) AS n
FROM spine s LEFT JOIN binned b ON b."column" = s."column" AND b.bin = s.bin"""


def interval(value: str) -> str:
    half = f"1.96::DOUBLE * stddev_samp({value}) / sqrt(count({value}))"
    return (f"count({value}) AS n, {rnd(f'avg({value})')} AS mean, "
            f"{rnd(f'avg({value}) - {half}')} AS ci_low, {rnd(f'avg({value}) + {half}')} AS ci_high")


def bootstrap(relations: str, rows: str, keys: str) -> str:
    """1000 replicas of 1024 slices weighted by Poisson(1) numbers, from the first 32 bits of an MD5."""
    h = "CAST('0x' || left(md5({}), 8) AS BIGINT)"
    cuts = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
    return f"""WITH {relations}, r AS ({rows}),
      su AS (SELECT {keys}, {h.format("coalesce(review_id, '')")} % 1024 AS slice, count(x) AS n, sum(x) AS x FROM r WHERE x IS NOT NULL GROUP BY ALL),
      ha AS (SELECT s.i AS slice, p.i AS replica, {h.format("s.i || ':' || p.i || ':42'")} AS h FROM range(1024) s(i), range(1000) p(i)),
      dr AS (SELECT slice, replica, {" + ".join(f"CAST(h >= {c} AS INTEGER)" for c in cuts)} AS w FROM ha),
      me AS (SELECT {keys}, replica, sum(w * x) / nullif(sum(w * n), 0) AS m FROM su JOIN dr USING (slice) GROUP BY ALL),
      ci AS (SELECT {keys}, {rnd("quantile_cont(m, 0.025)")} AS ci_low, {rnd("quantile_cont(m, 0.975)")} AS ci_high FROM me GROUP BY ALL)
      SELECT * FROM (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, {rnd("sum(x) / sum(n)")} AS mean FROM su GROUP BY ALL) JOIN ci USING ({keys})"""


def words_of(polarity: str, k: int) -> str:
    return f"(SELECT App, string_agg(word, ', ' ORDER BY rank) AS words FROM top WHERE polarity = '{polarity}' AND rank <= {k} GROUP BY App)"


def thousands(e: str) -> str:
    return f"format('{{:,}}', {e})"


LABELLED = """labelled AS (SELECT l.doc_id AS id, coalesce(d.text, '') AS text, CAST(l.quality AS INTEGER) AS label,
  CAST('0x' || left(md5(CAST(l.doc_id AS VARCHAR) || '-42'), 8) AS BIGINT) % 5 = 0 AS is_test
  FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"""

GLYPHS = "repeat('★', CAST(round_even(avg_star, 0) AS INTEGER)) || repeat('☆', 5 - CAST(round_even(avg_star, 0) AS INTEGER))"
HEAD = f"{label('r.App')} || ': ' || {fixed('avg_star', 2)} || '★ | sentiment ' || {fixed('avg_sentiment', 3)} || ' | ' || {thousands('total_reviews')} || ' reviews'"


def report(overlap) -> str:
    """Classification report of a relation pr(label, prediction)."""
    return f"""{overlap},
cls AS (SELECT DISTINCT label AS c FROM pr WHERE label IS NOT NULL UNION SELECT DISTINCT prediction FROM pr WHERE label IS NOT NULL),
m AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support,
  count(*) FILTER (prediction = c) AS predicted FROM cls, pr WHERE label IS NOT NULL GROUP BY c),
s AS (SELECT c, tp, support, coalesce(tp / nullif(predicted, 0), 0.0::DOUBLE) AS p, coalesce(tp / nullif(support, 0), 0.0::DOUBLE) AS r FROM m),
f AS (SELECT *, coalesce(2.0::DOUBLE * p * r / nullif(p + r, 0), 0.0::DOUBLE) AS f FROM s),
lines AS (SELECT CAST(c AS VARCHAR) AS class, p, r, f, support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f)
SELECT class, {rnd('p')} AS precision, {rnd('r')} AS recall, {rnd('f')} AS f1, CAST(support AS BIGINT) AS support FROM lines"""


def document_rows() -> str:
    """Every number and text of the insights document as rows."""
    return "WITH " + THEMED + "," + WORDS[len(TEXT) + 1:] + "," + SAMPLES[len(TEXT) + 1:] + f""",
tc AS (SELECT App, Review_Theme, count(*) AS n FROM themed GROUP BY ALL)
SELECT App, section, "key", CAST(place AS INTEGER) AS place, value FROM (
SELECT App, 'total' AS section, 'Total_Reviews' AS "key", 1 AS place, CAST(count(*) AS VARCHAR) AS value FROM reviews GROUP BY App
UNION ALL SELECT App, 'theme', Review_Theme, row_number() OVER (PARTITION BY App ORDER BY n DESC, Review_Theme), CAST(n AS VARCHAR) FROM tc
UNION ALL SELECT App, 'rating', CAST(star AS VARCHAR), star, CAST(count(*) FILTER (Star_Rating = star) AS VARCHAR) FROM reviews, range(1, 6) t(star) GROUP BY App, star
UNION ALL SELECT App, polarity, word, rank, CAST(n AS VARCHAR) FROM top
UNION ALL SELECT App, 'sample_' || side, CAST(star AS VARCHAR), rank, text FROM samples
UNION ALL SELECT App, 'daily', day, row_number() OVER (PARTITION BY App ORDER BY day), CAST(n AS VARCHAR)
  FROM (SELECT App, strftime(Review_Date, '%Y-%m-%d') AS day, count(Star_Rating) AS n FROM reviews GROUP BY ALL)
UNION ALL SELECT App, 'monthly', month, row_number() OVER (PARTITION BY App ORDER BY month), CAST(n AS VARCHAR)
  FROM (SELECT App, strftime(Review_Date, '%Y-%m') AS month, count(Star_Rating) AS n FROM reviews GROUP BY ALL))"""


def build() -> dict[str, str]:
    b, t, th, tc, w = (f"WITH {x}\n" for x in (BASE, TEXT, THEMED, TCOUNTS, WORDS))
    unix = "CAST(epoch({0}) AS BIGINT)"
    q: dict[str, str] = {}

    # sources
    q["scan_reviews"] = t + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, nullif(Review_Text, '') AS Review_Text, Word_Count, Review_Length_Chars, Thumbs_Up_Count, App_Version, Sentiment_Polarity FROM full_reviews"
    q["scan_raw"] = t + f"SELECT App, review_id AS \"reviewId\", {sec('Review_Date')} AS \"at\", Star_Rating AS score, Review_Text AS content, Thumbs_Up_Count AS \"thumbsUpCount\", App_Version AS \"appVersion\" FROM texted"
    q["newest_n_per_app"] = b + "SELECT App, review_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY App ORDER BY Review_Date DESC, review_id) AS INTEGER) AS rank FROM reviews) WHERE rank <= 500"
    q["union_schema_drift"] = b + f"SELECT CASE WHEN Review_Date >= TIMESTAMP '2024-01-11' THEN review_id END AS review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, Thumbs_Up_Count FROM reviews"
    q["newest_5000_per_app"] = q["newest_n_per_app"].replace("rank <= 500", "rank <= 5000")
    q["append_reviews"] = t + "SELECT App, count(*) AS n, CAST(sum(Word_Count) AS BIGINT) AS words, CAST(sum(Review_Length_Chars) AS BIGINT) AS chars FROM full_reviews GROUP BY App"
    q["rewrite_reviews"] = th + "SELECT App, Review_Theme, count(*) AS n, CAST(0 AS BIGINT) AS still_missing FROM themed GROUP BY ALL"
    q["insights_explode"] = document_rows()
    q["watermark_state"] = b + f", mark AS (SELECT max(Review_Date) AS m FROM reviews WHERE Review_Date > TIMESTAMP '2024-01-10' AND Review_Date <= TIMESTAMP '2024-01-20') SELECT count(*) AS rows_after, {sec('(SELECT m FROM mark)')} AS last_run FROM reviews WHERE Review_Date > (SELECT m FROM mark)"
    q["batch_metrics"] = b + "SELECT d.App, count(r.review_id) AS added FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) d(App) LEFT JOIN reviews r ON r.App = d.App AND r.Review_Date > TIMESTAMP '2024-01-20' GROUP BY d.App"
    q["dim_product_join"] = b + """SELECT r.App, n AS total_reviews, p AS package_id, coalesce(c, '#666') AS colour FROM (SELECT App, count(*) AS n FROM reviews GROUP BY App) r
      LEFT JOIN (VALUES ('click', 'store.click', '#10a37f'), ('error', 'store.error', '#d97757'), ('purchase', 'store.purchase', '#4285f4'), ('signup', 'store.signup', '#0078d4'), ('refund', 'store.refund', NULL)) d(App, p, c) ON d.App = r.App"""

    # projections and filters
    q["normalize_reviews"] = t + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, Review_Text, Word_Count, Review_Length_Chars, Thumbs_Up_Count, coalesce(App_Version, 'Unknown') AS App_Version FROM full_reviews"
    q["word_count"] = t + "SELECT review_id, Word_Count FROM full_reviews"
    q["char_length"] = t + "SELECT review_id, Review_Length_Chars FROM full_reviews"
    q["parse_date_coerce"] = b + f"SELECT review_id, {sec('TRY_CAST(x AS TIMESTAMP)')} AS parsed FROM (SELECT review_id, CASE WHEN Thumbs_Up_Count % 9 = 0 THEN 'not a date' ELSE {sec('Review_Date')} END AS x FROM reviews)"
    q["date_keys"] = b + f"SELECT review_id, {DAY} AS day, strftime(Review_Date, '%Y-%m') AS month FROM reviews"
    q["fill_unknown"] = b + "SELECT coalesce(App_Version, 'Unknown') AS App_Version, count(*) AS n FROM reviews GROUP BY 1"
    q["binary_label"] = b + "SELECT review_id, CASE WHEN Star_Rating >= 4 THEN 1 ELSE 0 END AS label FROM reviews"
    capped = "least(CAST(Thumbs_Up_Count AS DOUBLE), (SELECT quantile_cont(CAST(Thumbs_Up_Count AS DOUBLE), 0.99) FROM reviews))"
    q["winsorize_p99"] = b + f"SELECT review_id, {rnd(capped)} AS Thumbs_Up_Capped FROM reviews"
    q["time_window_filter"] = b + f"SELECT App, count(*) AS n, {sec('min(Review_Date)')} AS first_at, {sec('max(Review_Date)')} AS last_at FROM reviews WHERE Review_Date > TIMESTAMP '2024-01-10' AND Review_Date <= TIMESTAMP '2024-01-20' GROUP BY App"
    q["missing_rows"] = b + "SELECT count(*) AS total_rows, count(*) FILTER (Sentiment_Polarity IS NULL OR Star_Rating <> 5) AS missing_rows, count(*) FILTER (Sentiment_Polarity IS NULL) AS missing_polarity, count(*) FILTER (Star_Rating <> 5) AS missing_theme FROM reviews"
    q["star_bands"] = b + "SELECT App, count(*) FILTER (Star_Rating >= 4) AS positive, count(*) FILTER (Star_Rating <= 2) AS negative, count(*) FILTER (Star_Rating = 1) AS one_star, count(*) FILTER (Star_Rating = 5) AS five_star FROM reviews GROUP BY App"
    q["viral_reviews"] = b + "SELECT App, Star_Rating, Thumbs_Up_Count, review_id FROM reviews WHERE Thumbs_Up_Count >= 200 ORDER BY Thumbs_Up_Count DESC, review_id LIMIT 10"
    q["viral_count"] = b + "SELECT App, count(*) AS n FROM reviews WHERE Thumbs_Up_Count >= 200 GROUP BY App"
    q["search_reviews"] = t + "SELECT review_id, App, Star_Rating, Review_Text FROM texted WHERE contains(lower(Review_Text), 'expensive')"
    q["search_reviews_indexed"] = q["search_reviews"]
    q["search_one_product"] = t + "SELECT review_id, Star_Rating, Review_Text FROM texted WHERE App = 'click' AND contains(lower(Review_Text), 'crashing')"
    q["search_conversations"] = "SELECT conv_id, turn, role, text FROM conversations WHERE contains(lower(text), 'the')"
    q["search_highlight"] = t + r"SELECT review_id, regexp_replace(Review_Text, '(?i)(not working)', '<mark>\1</mark>', 'g') AS highlighted FROM texted WHERE contains(lower(Review_Text), 'not working')"

    # text
    q["theme_classify"] = th + "SELECT review_id, Review_Theme AS theme FROM themed"
    s = f"WITH {SCORED}\n"
    q["sentiment_lexicon"] = s + f"SELECT r.review_id, coalesce({rnd('polarity')}, 0.0::DOUBLE) AS polarity FROM reviews r LEFT JOIN score USING (review_id)"
    q["opinion_words"] = s + f"SELECT App, word, count(*) AS hits, {rnd('avg(score)')} AS mean_score FROM hit GROUP BY ALL"
    filled = rnd("coalesce(Sentiment_Polarity, polarity, 0.0::DOUBLE)")
    q["backfill_enrich"] = s + f"SELECT r.review_id, {filled} AS Sentiment_Polarity, Review_Theme FROM themed r LEFT JOIN score s ON s.review_id = r.review_id"
    q["tokens"] = t + "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(Review_Text), '[a-z]+')) AS word FROM texted) GROUP BY word"
    q["document_tokens"] = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word"
    q["keywords_topk"] = w + "SELECT App, polarity, word, n, rank FROM top"
    q["keywords_merge_topk"] = w + "SELECT polarity, word, n, rank FROM cloud"
    q["keywords_exact_topk"] = w + "SELECT polarity, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) AS INTEGER) AS rank FROM (SELECT polarity, word, CAST(sum(n) AS BIGINT) AS n FROM kc GROUP BY ALL)) WHERE rank <= 40"
    q["keywords_exact_from_counts"] = q["keywords_exact_topk"]
    q["cloud_weights"] = w + """, lim AS (SELECT polarity, min(n) AS low, max(n) AS high FROM cloud GROUP BY 1)
      SELECT polarity, rank, word, n, round(CASE WHEN high = low THEN 1.4::DOUBLE ELSE 0.8::DOUBLE + (n - low) / (high - low) * 1.6::DOUBLE END, 6) AS size,
      round(0.55::DOUBLE + (n - low) / (CASE WHEN high > low THEN high - low ELSE 1 END) * 0.45::DOUBLE, 6) AS opacity FROM cloud JOIN lim USING (polarity)"""
    q["keyword_prefix"] = w + "SELECT App, polarity, string_agg(word, ', ' ORDER BY rank) AS words FROM top WHERE rank <= 5 GROUP BY ALL"
    q["negative_digest"] = f"WITH {NEGATIVE}\n" + f"""SELECT App, count(Review_Text) AS n_reviews, 'Product: ' || {label('App')} || chr(10) || 'Name the recurring complaints in these one-star reviews and how often each occurs.' || chr(10) || '- '
      || coalesce(string_agg(Review_Text, chr(10) || '- ' ORDER BY rank), '') AS digest FROM negative GROUP BY App"""

    # aggregates
    ov = f"WITH {BASE}{OV}\n"
    rk = f"WITH {BASE}{OV}{RANKED}\n"
    q["overview"] = ov + "SELECT * FROM ov"
    rd = b + ", rd AS (SELECT App, CAST(star AS INTEGER) AS star, count(*) FILTER (Star_Rating = star) AS n FROM reviews, range(1, 6) t(star) GROUP BY App, star) "
    q["rating_distribution"] = rd + "SELECT * FROM rd"
    q["rating_rollup"] = rd + "SELECT star, CAST(sum(n) AS BIGINT) AS n FROM rd GROUP BY star"
    q["theme_counts"] = tc + "SELECT * FROM tc"
    q["theme_rollup"] = tc + "SELECT Review_Theme, CAST(sum(n) AS BIGINT) AS n FROM tc GROUP BY 1"
    q["theme_share"] = tc + f"SELECT App, Review_Theme, n, {pct('n', 'sum(n) OVER (PARTITION BY App)')} AS share_pct FROM tc"
    q["daily_series"] = f"WITH {DAILY}\nSELECT * FROM daily ORDER BY App, day"
    q["monthly_series"] = MONTHLY + " ORDER BY App, month"
    q["monthly_from_daily"] = MONTHLY
    q["daily_scaled"] = f"WITH {DAILY}\nSELECT App, day, avg_sentiment, {rnd('avg_star / 5', 6)} AS avg_star_scaled FROM daily"
    apps = ["click", "error", "purchase", "signup", "view"]
    q["series_compare"] = f"WITH {DAILY}\nSELECT day, " + ", ".join(f'max(avg_sentiment) FILTER (App = {lit(a)}) AS "{a}"' for a in apps) + " FROM daily GROUP BY day"
    q["kpi_rollup"] = f"WITH {BASE}{ROLL}\nSELECT * FROM kr"
    q["kpi_weighted_all"] = ov + f"SELECT CAST(sum(total_reviews) AS BIGINT) AS total_reviews, {rnd('sum(avg_star * total_reviews) / sum(total_reviews)')} AS avg_star, {rnd('sum(avg_sentiment * total_reviews) / sum(total_reviews)')} AS avg_sentiment FROM ov"
    q["star_shares"] = b + f"SELECT App, {pct('count(*) FILTER (Star_Rating = 5)', 'count(*)')} AS five_star_pct, {pct('count(*) FILTER (Star_Rating = 1)', 'count(*)')} AS one_star_pct FROM reviews GROUP BY App"
    q["top_pain_point"] = tc + f"SELECT * FROM {PAIN}"
    q["top_theme"] = tc + f"SELECT * FROM {TOP}"
    q["product_ranking"] = rk + "SELECT * FROM ranked"
    q["polarisation_ranking"] = ov + "SELECT CAST(row_number() OVER (ORDER BY std_dev DESC, App) AS INTEGER) AS rank, App, std_dev FROM ov"
    q["uplift_vs_median"] = ov + f"SELECT App, avg_star, {rnd('(SELECT median(avg_star) FROM ov)')} AS median_star, {pct('(avg_star - (SELECT median(avg_star) FROM ov))', '(SELECT median(avg_star) FROM ov)', 2)} AS uplift_pct FROM ov"
    q["market_overview"] = f"WITH {TCOUNTS}{OV}\n" + f"SELECT o.App, avg_star, avg_sentiment, top_theme AS top_pain_point, {pct('theme_reviews', 'total_reviews')} AS pain_share_pct FROM ov o LEFT JOIN {PAIN} p ON p.App = o.App"
    q["star_sentiment_corr"] = b + f"SELECT coalesce(App, 'All') AS App, {rnd('corr(CAST(Star_Rating AS DOUBLE), Sentiment_Polarity)')} AS corr, count(*) AS n FROM reviews WHERE Sentiment_Polarity IS NOT NULL GROUP BY GROUPING SETS ((App), ())"
    q["zero_share"] = s + f"SELECT App, {pct('count(*) FILTER (p = 0)', 'count(p)', 2)} AS zero_pct FROM (SELECT App, coalesce(Sentiment_Polarity, polarity, 0.0::DOUBLE) AS p FROM reviews r LEFT JOIN score s ON s.review_id = r.review_id) GROUP BY App"
    q["sample_reviews"] = f"WITH {SAMPLES}\nSELECT * FROM samples"
    q["sample_union"] = f"WITH {SAMPLES}\nSELECT App, side, rank, star, text FROM samples"
    q["top50_negative"] = f"WITH {NEGATIVE}\nSELECT App, rank, review_id, Review_Text FROM negative"
    q["balanced_sample"] = b + "SELECT App, rank, review_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY App ORDER BY md5(review_id || '-42'), review_id) AS INTEGER) AS rank FROM reviews) WHERE rank <= 100"
    q["balanced_sample_5000"] = q["balanced_sample"].replace("rank <= 100", "rank <= 5000")

    # comparison and reports
    cards = f"WITH {CARDS}\n"
    q["compare_two"] = f"WITH {CARDS}, rc AS (SELECT * FROM cards)\n" + side_by_side("App = 'click'", "App = 'view'", "top_pain_point")
    q["compare_top2"] = f"WITH {CARDS}, rc AS (SELECT *, row_number() OVER (ORDER BY avg_star DESC, App) AS rank FROM cards)\n" + side_by_side("rank = 1", "rank = 2", "top_any")
    q["theme_compare"] = tc + "SELECT Review_Theme, CAST(coalesce(sum(n) FILTER (App = 'click'), 0) AS BIGINT) AS first, CAST(coalesce(sum(n) FILTER (App = 'view'), 0) AS BIGINT) AS second FROM tc WHERE App IN ('click', 'view') GROUP BY 1"
    q["insight_banner"] = ov + " UNION ALL ".join(
        f"(SELECT {lit(n)} AS fact, App, {m} AS value FROM ov ORDER BY {m} {d}, App LIMIT 1)"
        for n, m, d in [("highest rated", "avg_star", "DESC"), ("lowest rated", "avg_star", "ASC"),
                        ("most positive", "avg_sentiment", "DESC"), ("most polarised", "std_dev", "DESC")])
    q["product_banner"] = cards + f"SELECT App, CAST(row_number() OVER (ORDER BY avg_star DESC, App) AS INTEGER) AS rank, {fixed('avg_star', 2)} AS rating, {fixed('avg_sentiment', 3)} AS sentiment, five_star_pct, one_star_pct, top_pain_point FROM cards"
    q["ranking_rows"] = rk + f"SELECT rank, {label('App')} AS product, {GLYPHS} AS stars, {fixed('avg_star', 2)} AS rating, {fixed('avg_sentiment', 3)} AS sentiment, CASE WHEN avg_sentiment > 0.4 THEN 'pos' ELSE 'neg' END AS band, {thousands('total_reviews')} AS reviews FROM ranked"
    q["kpi_cards"] = f"WITH {BASE}{ROLL}\n" + " UNION ALL ".join([
        f"SELECT App, 'Total Reviews' AS label, {thousands('total_reviews')} AS value FROM kr",
        f"SELECT App, 'Avg Star Rating', {fixed('avg_star', 2)} FROM kr",
        f"SELECT App, 'Avg Sentiment', {fixed('avg_sentiment', 3)} FROM kr",
        f"SELECT App, 'Rating Std Dev', {fixed('std_dev', 2)} FROM kr WHERE App <> 'All'"])
    wr = f"WITH {WORDS}{OV}{RANKED}\n"
    q["leader_card"] = wr + f"SELECT {label('r.App')} AS product, {fixed('avg_star', 2)} AS rating, {fixed('avg_sentiment', 3)} AS sentiment, {thousands('total_reviews')} AS reviews, words AS users_say FROM ranked r LEFT JOIN {words_of('positive', 6)} k ON k.App = r.App WHERE rank = 1"
    q["concern_rows"] = wr + f"SELECT {label('r.App')} AS product, words AS concerns FROM ranked r LEFT JOIN {words_of('negative', 3)} k ON k.App = r.App"
    nl = " || chr(10) || "
    blocks = {
        "weekly": nl.join([HEAD, f"'  Top theme: ' || top_theme || ' (' || {thousands('theme_reviews')} || ' reviews)'", "'  Top positive keywords: ' || coalesce(p5.words, '')", "'  Top negative keywords: ' || coalesce(n5.words, '')"]),
        "mail": nl.join([HEAD, "'  Top theme: ' || top_theme", "'  Positive keywords: ' || coalesce(p5.words, '')", "'  Negative keywords: ' || coalesce(n5.words, '')"]),
        "bot": nl.join([f"'## ' || {label('r.App')}", f"'- Average Star Rating: ' || {fixed('avg_star', 2)} || ' / 5'", f"'- Average Sentiment Polarity: ' || {fixed('avg_sentiment', 3)}",
                        f"'- Rating Std Dev: ' || {fixed('std_dev', 2)}", f"'- Total Reviews: ' || {thousands('total_reviews')}", "'- Review Themes: ' || themes",
                        "'- Top Positive Keywords: ' || coalesce(p6.words, '')", "'- Top Negative Keywords: ' || coalesce(n6.words, '')"]),
        "script": f"{label('r.App')} || ': ' || {fixed('avg_star', 2)} || '★, sentiment ' || {fixed('avg_sentiment', 3)} || ', ' || {thousands('total_reviews')} || ' reviews'",
    }
    sources = f"""ranked r LEFT JOIN {TOP} t ON t.App = r.App
      LEFT JOIN (SELECT App, string_agg(Review_Theme || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, Review_Theme) AS themes FROM tc GROUP BY App) h ON h.App = r.App
      LEFT JOIN {words_of('positive', 5)} p5 ON p5.App = r.App LEFT JOIN {words_of('negative', 5)} n5 ON n5.App = r.App
      LEFT JOIN {words_of('positive', 6)} p6 ON p6.App = r.App LEFT JOIN {words_of('negative', 6)} n6 ON n6.App = r.App"""
    q["context_lines"] = f"WITH {TCOUNTS},{WORDS[len(TEXT) + 1:]}{OV}{RANKED}\n" + " UNION ALL ".join(
        f"SELECT r.App, {lit(name)} AS report, {block} AS block FROM {sources}" for name, block in blocks.items())

    # duplicates
    q["new_reviews_anti"] = b + "SELECT review_id, App FROM reviews WHERE Review_Date > TIMESTAMP '2024-01-20'"
    q["quarantined_ids"] = b + "SELECT App, CASE WHEN Thumbs_Up_Count % 10 IN (0, 1) THEN 'aside' ELSE 'kept' END AS side, count(*) AS n FROM reviews GROUP BY ALL"
    q["dedup_keep_last"] = t + "SELECT review_id, App, Star_Rating, Review_Text FROM (SELECT *, row_number() OVER (PARTITION BY App, Review_Text ORDER BY Review_Date DESC NULLS FIRST, review_id DESC) AS r FROM texted) WHERE r = 1"
    dup = t + ", dup AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY Review_Text) AS c FROM texted) WHERE c > 1) "
    q["duplicate_rows"] = dup + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, Review_Text FROM dup"
    q["duplicate_listing"] = dup + f"SELECT App, {sec('Review_Date')} AS Review_Date, Star_Rating, Review_Text, review_id FROM (SELECT * FROM dup ORDER BY Review_Text NULLS FIRST, App, dup.Review_Date, review_id LIMIT 20)"
    q["duplicate_patterns"] = t + f""", seen AS (SELECT Review_Text, date_trunc('second', Review_Date) AS sec_at, App, Star_Rating FROM texted WHERE Review_Text IS NOT NULL),
      linked AS (SELECT *, lag(sec_at) OVER o AS pat, lag(App) OVER o AS papp, lag(Star_Rating) OVER o AS pstar FROM seen WINDOW o AS (PARTITION BY Review_Text ORDER BY sec_at, App, Star_Rating)),
      g AS (SELECT *, {unix.format('sec_at')} - {unix.format('pat')} AS gap FROM linked WHERE pat IS NOT NULL)
      SELECT CASE WHEN App <> papp AND gap <= 3600 THEN 'spam' WHEN App <> papp THEN 'ambiguous' WHEN Star_Rating <> pstar THEN 'updated' ELSE 'repeated' END AS pattern,
        count(*) AS links, min(gap) AS min_gap_seconds, max(gap) AS max_gap_seconds FROM g GROUP BY 1"""
    q["dup_row_count"] = b + f"SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM reviews GROUP BY App, {DAY}, Star_Rating, Thumbs_Up_Count, App_Version)"
    q["dup_text_count"] = t + "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM texted GROUP BY Review_Text)"
    q["dup_document_count"] = "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)"

    # profiles
    names = [c for c, _ in COLUMNS]
    q["null_counts"] = t + per_column(lambda c: f"SELECT {lit(c)} AS \"column\", count(*) - count({column(c)}) AS nulls FROM full_reviews", names)
    q["nunique"] = t + per_column(lambda c: f"SELECT {lit(c)} AS \"column\", count(DISTINCT {column(c)}) AS \"distinct\" FROM full_reviews", [n for n in names if n != "Review_Date"])
    q["distinct_values"] = th + per_column(lambda c: f"SELECT DISTINCT {lit(c)} AS \"column\", {c} AS value FROM themed", ["App", "Review_Theme"])
    q["category_counts"] = th + per_column(lambda c: f"SELECT {lit(c)} AS \"column\", {c} AS value, count(*) AS n FROM themed GROUP BY ALL", ["App", "Review_Theme"])
    q["profile_columns"] = t + " UNION ALL ".join(f"SELECT {lit(c)} AS \"column\", {lit(k)} AS type, count({column(c)}) AS non_null FROM full_reviews" for c, k in COLUMNS)
    q["describe_numeric"] = t + per_column(lambda c: f"""SELECT {lit(c)} AS "column", count({c}) AS "count", {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std,
      {rnd(f'min({c})::DOUBLE')} AS min, {rnd(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, {rnd(f'quantile_cont({c}::DOUBLE, 0.5)')} AS q50, {rnd(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, {rnd(f'max({c})::DOUBLE')} AS max FROM full_reviews""", NUMERIC)
    q["row_listing"] = b + "SELECT review_id, App, Star_Rating, Thumbs_Up_Count FROM reviews ORDER BY Review_Date, review_id LIMIT 5"
    q["p99"] = b + f"SELECT {rnd('quantile_cont(CAST(Thumbs_Up_Count AS DOUBLE), 0.99)')} AS p99 FROM reviews"
    q["quantiles_by_app"] = b + "SELECT App, " + ", ".join(f"{rnd(f'quantile_cont(Sentiment_Polarity, {p})')} AS {n}" for n, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]) + " FROM reviews GROUP BY App"
    q["box_stats_by_star"] = f"WITH {BASE}" + box("Star_Rating", "reviews", "Sentiment_Polarity")
    q["box_stats_thumbs"] = f"WITH {BASE}" + box("'Thumbs_Up_Count'", "reviews", "Thumbs_Up_Count")
    q["mean_thumbs_ci"] = b + f"SELECT App, {interval('x')} FROM (SELECT App, {capped} AS x FROM reviews) GROUP BY App"
    q["star_by_app_theme"] = th + f"SELECT App, Review_Theme, {interval('Star_Rating')} FROM themed GROUP BY ALL"
    q["mean_thumbs_bootstrap"] = bootstrap(BASE, f"SELECT review_id, App, {capped} AS x FROM reviews", "App")
    q["star_by_app_theme_bootstrap"] = bootstrap(THEMED, "SELECT review_id, App, Review_Theme, CAST(Star_Rating AS DOUBLE) AS x FROM themed", "App, Review_Theme")
    long = per_column(lambda c: f"SELECT {lit(c)} AS \"column\", CAST({c} AS DOUBLE) AS value FROM full_reviews", NUMERIC)
    q["histogram_20"] = f"WITH {TEXT},\n" + histogram(long, 20)
    q["histogram_zoom"] = f"WITH {BASE},\n" + histogram("SELECT 'Thumbs_Up_Count' AS \"column\", CAST(Thumbs_Up_Count AS DOUBLE) AS value FROM reviews WHERE Thumbs_Up_Count <= 100", 50)
    q["histogram_log"] = f"WITH {BASE},\n" + histogram("SELECT 'log10_Thumbs_Up_Count' AS \"column\", log10(Thumbs_Up_Count + 1) AS value FROM reviews", 50)
    q["kde_grid"] = b + f""", v AS (SELECT Sentiment_Polarity AS v, count(*) AS n FROM reviews WHERE v IS NOT NULL GROUP BY 1),
      st AS (SELECT min(Sentiment_Polarity) AS low, max(Sentiment_Polarity) AS high, count(Sentiment_Polarity) AS total, stddev_samp(Sentiment_Polarity) * pow(count(Sentiment_Polarity), -0.2) AS h FROM reviews),
      g AS (SELECT CAST(i AS INTEGER) AS point, low + i * (high - low) / 199.0::DOUBLE AS x, total, h FROM st, range(200) t(i))
      SELECT point, {rnd('any_value(x)', 6)} AS x, {rnd('sum(n * exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (total * h * sqrt(2.0 * pi())))', 6)} AS density FROM g, v GROUP BY point"""

    q["kde_grid_binned"] = b + f""", st AS (SELECT min(Sentiment_Polarity) AS low, max(Sentiment_Polarity) AS high, count(Sentiment_Polarity) AS total, stddev_samp(Sentiment_Polarity) * pow(count(Sentiment_Polarity), -0.2) AS h FROM reviews),
      p AS (SELECT (Sentiment_Polarity - low) / ((high - low) / 1592.0::DOUBLE) AS place FROM reviews, st WHERE Sentiment_Polarity IS NOT NULL),
      c AS (SELECT least(floor(place), 1591) AS cell, place FROM p),
      v AS (SELECT g, sum(w) AS n FROM (SELECT cell AS g, 1 - (place - cell) AS w FROM c UNION ALL SELECT cell + 1, place - cell FROM c) GROUP BY g),
      g AS (SELECT CAST(i AS INTEGER) AS point, low, (high - low) / 1592.0::DOUBLE AS step, total, h FROM st, range(200) t(i))
      SELECT point, {rnd('any_value(low + point * 8 * step)', 6)} AS x, {rnd('sum(n * exp(-0.5 * pow((point * 8 - g.g) * step / h, 2)) / (total * h * sqrt(2.0 * pi())))', 6)} AS density FROM (SELECT * FROM g, v) AS g GROUP BY point"""

    # classification
    q["ml_dataset"] = t + "SELECT review_id AS id, coalesce(Review_Text, '') AS text, CASE WHEN Star_Rating >= 4 THEN 1 ELSE 0 END AS label FROM texted"
    q["ml_split"] = f"WITH {LABELLED} SELECT id, label, is_test FROM labelled"
    stop = ", ".join(lit(x) for x in fv.ENGLISH_STOP_WORDS)
    q["ml_idf"] = f"""WITH {LABELLED}, train AS (SELECT * FROM labelled WHERE NOT is_test),
      wd AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM train),
      g AS (SELECT word, count(*) AS term_count, count(DISTINCT id) AS df FROM wd WHERE word NOT IN ({stop}) GROUP BY word ORDER BY term_count DESC, word LIMIT 5000)
      SELECT word, term_count, df, {rnd('ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1.0::DOUBLE + df)) + 1.0', 6)} AS idf FROM g"""
    q["ml_tfidf_weights"] = q["ml_idf"].split("SELECT word, term_count, df")[0].rstrip() + f""",
      i AS (SELECT word, ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM g),
      aw AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM labelled),
      x AS (SELECT id, word, count(*) * any_value(idf) AS x FROM aw JOIN i USING (word) GROUP BY id, word)
      SELECT id, word, {rnd('x / sqrt(sum(x * x) OVER (PARTITION BY id))', 6)} AS weight FROM x"""
    q["classification_report"] = report("WITH pr AS (SELECT quality AS label, toxic AS prediction FROM labels)")
    q["confusion_matrix"] = "SELECT quality AS label, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM labels WHERE quality IS NOT NULL GROUP BY 1"

    # streams
    q["stream_ingest"] = t + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, Word_Count FROM full_reviews WHERE date_trunc('second', Review_Date) > TIMESTAMP '2024-01-01' AND date_trunc('second', Review_Date) <= TIMESTAMP '2024-01-25'"
    q["stream_dedup"] = b + "SELECT review_id, App, Star_Rating FROM reviews"
    q["stream_new_only"] = b + "SELECT review_id, App FROM reviews WHERE Review_Date > TIMESTAMP '2024-01-20'"
    q["stream_enrich"] = s + f"SELECT r.review_id, coalesce({rnd('polarity')}, 0.0::DOUBLE) AS Sentiment_Polarity, Review_Theme FROM themed r LEFT JOIN score s ON s.review_id = r.review_id"
    q["stream_daily"] = f"WITH {DAILY}\nSELECT * FROM daily"
    q["stream_monthly"] = b + f"SELECT App, strftime(Review_Date, '%Y-%m') AS month, {SERIES} FROM reviews GROUP BY ALL"
    q["stream_exact_ingest"] = t + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating, Word_Count FROM full_reviews"
    q["stream_ingest_metrics"] = b + "SELECT App, count(*) AS added FROM reviews GROUP BY App"
    q["scan_reviews_window"] = b + f"SELECT review_id, App, {sec('Review_Date')} AS Review_Date, Star_Rating FROM reviews WHERE date_trunc('second', Review_Date) > TIMESTAMP '2024-01-10' AND date_trunc('second', Review_Date) <= TIMESTAMP '2024-01-20'"
    q["quarantine"] = b + "SELECT CASE WHEN Thumbs_Up_Count % 50 = 0 THEN 'malformed' ELSE 'no id' END AS reason, count(*) AS n FROM reviews WHERE Thumbs_Up_Count % 50 IN (0, 1) GROUP BY 1"
    q["incremental_refresh"] = f"WITH {DAILY}\nSELECT * FROM daily"
    q["overview_from_cube"], q["daily_from_cube"] = q["overview"], q["stream_daily"]
    q["distinct_from_sketches"] = b + "SELECT App, count(DISTINCT review_id) AS exact, true AS within_bound FROM reviews WHERE strftime(Review_Date, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-25' GROUP BY App"
    q["median_from_sketches"] = b + "SELECT App, count(Thumbs_Up_Count) AS n, true AS within_bound FROM reviews GROUP BY App"
    return q
