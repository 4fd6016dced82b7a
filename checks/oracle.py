"""SQL counterpart of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

from checks.derived import HEADER_SETS, HEADERS, INGEST_TS, LEXICON, RAW_COLUMNS, TIME_FORMS
from checks.queries import CRISIS_TOPICS, IMPORTS
from hearsay.functions.text import WHITESPACE
from hearsay.schema import DISASTER_WORDS, HAPPY_WORDS, PLATFORMS, SAD_WORDS, STOPWORDS

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TAG = r"#([\pL\pN_]+)"
_WORD = r"[\pL\pN_][\pL\pN_'']+"


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def _clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '@[A-Za-z0-9_]+', '', 'g')"
    out = f"replace({out}, '#', '')"
    out = f"regexp_replace({out}, 'RT[{_SPACE}]+', '', 'g')"
    return _trim(f"regexp_replace({out}, 'https?://[^{_SPACE}]+', '', 'g')")


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{_WORD}')"


def _count(x: str) -> str:
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"CASE WHEN regexp_full_match({_trim(x)}, '{number}') "
        f"THEN coalesce(TRY_CAST(trunc(TRY_CAST({_trim(x)} AS DOUBLE)) AS BIGINT), 0) ELSE 0 END"
    )


def _keyword(x: str) -> str:
    cases = [
        f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN '{name}'"
        for name, words in (("Disaster", DISASTER_WORDS), ("Happy", HAPPY_WORDS), ("Sad", SAD_WORDS))
    ]
    return "CASE " + " ".join(cases) + " END"


def _polar(p: str) -> str:
    return f"CASE WHEN {p} > 0.1 THEN 'Positive' WHEN {p} < -0.1 THEN 'Negative' ELSE 'Neutral' END"


_LEXICON = "lexicon AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', CAST({round(p * 1_000_000_000)} AS BIGINT))" for w, p, _ in LEXICON
) + ") AS v(word, units))"


def _polarity(source: str, key: str, text: str) -> str:
    """CTEs ``tok`` and ``pol`` with the mean polarity per key."""
    return f"""tok AS (SELECT {key} AS k, unnest({_words(text)}) AS word FROM {source}),
pol AS (SELECT k, CAST(sum(units) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1000000000.0::DOUBLE AS polarity
  FROM tok JOIN lexicon USING (word) GROUP BY k)"""


_PLATFORM = (
    f"CASE WHEN platform_ IS NULL OR {_trim('platform_')} IN ('', 'nan', 'None') THEN 'Unknown' "
    + " ".join(f"WHEN lower({_trim('platform_')}) = '{p.lower()}' THEN '{p}'" for p in PLATFORMS)
    + f" ELSE {_trim('platform_')} END"
)

_RAW = (
    "raw AS (SELECT "
    + ",\n".join(f"{sql} AS {name}" for name, sql in RAW_COLUMNS.items())
    + """
FROM events LEFT JOIN customer ON user_id = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
)

_NORM = f"""norm AS (SELECT
  md5(CAST(idx AS VARCHAR) || chr(1) || text_) AS post_id, text_ AS text,
  coalesce(TRY_CAST(time_ AS TIMESTAMP), TIMESTAMP '{INGEST_TS}') AS created_at,
  {_count('retweets_')} AS retweet_count, {_count('likes_')} AS like_count,
  coalesce(user_, 'unknown') AS username, {_count('followers_')} AS user_followers,
  nullif(location_, '') AS location, {_PLATFORM} AS platform, coalesce(hashtags_, '') AS hashtags, idx
FROM raw)"""

_BAG = f"""list_concat(CASE WHEN starts_with(coalesce(hashtags_, ''), '[')
    THEN coalesce(TRY_CAST(TRY_CAST(replace(hashtags_, '''', '"') AS JSON) AS VARCHAR[]),
                  regexp_extract_all(hashtags_, '{_TAG}', 1))
    ELSE regexp_extract_all(coalesce(hashtags_, ''), '{_TAG}', 1) END,
  regexp_extract_all(coalesce(text_, ''), '{_TAG}', 1))"""


def _location(x: str) -> str:
    t = _trim(x)
    n = f"len(string_split({t}, ','))"
    part = lambda i: f"nullif({_trim(f'string_split({t}, chr(44))[{i}]')}, '')"
    return f"""CASE WHEN {n} IN (2, 3) THEN {part(1)} END AS city,
  CASE WHEN {n} = 3 THEN {part(2)} END AS state,
  CASE WHEN {n} = 3 THEN {part(3)} WHEN {n} = 2 THEN {part(2)} ELSE nullif({t}, '') END AS country"""


_POST = f"""cleaned AS (SELECT idx, {_clean('text_')} AS cleaned_text FROM raw),
{_polarity('cleaned', 'idx', 'cleaned_text')},
post AS (SELECT n.post_id, n.text, c.cleaned_text, n.created_at,
  coalesce({_keyword('c.cleaned_text')}, {_polar('p.polarity')}) AS sentiment,
  n.retweet_count, n.like_count, n.username, n.user_followers, n.location,
  {_location('n.location')}, n.platform,
  CAST(year(n.created_at) AS INTEGER) AS year, CAST(month(n.created_at) AS INTEGER) AS month,
  CAST(day(n.created_at) AS INTEGER) AS day, CAST(hour(n.created_at) AS INTEGER) AS hour,
  {_BAG} AS tags
  FROM norm n JOIN cleaned c USING (idx) JOIN raw r USING (idx) LEFT JOIN pol p ON p.k = n.idx)"""

_WITH = f"WITH {_LEXICON},\n{_RAW},\n{_NORM},\n{_POST}"


def _posts(select: str, *ctes: str) -> str:
    return ",\n".join([_WITH, *ctes]) + "\n" + select


def _raw(select: str) -> str:
    return f"WITH {_RAW}\n{select}"


_BIG = "CAST({} AS BIGINT)".format

_PLACES = """place AS (SELECT
  CASE WHEN city IS NOT NULL AND city NOT IN ('', 'None', 'nan') THEN 'city'
       WHEN state IS NOT NULL AND state NOT IN ('', 'None', 'nan') THEN 'state'
       WHEN country IS NOT NULL AND country NOT IN ('', 'None', 'nan') THEN 'country' END AS level, *
  FROM post),
place_count AS (SELECT level,
  CASE level WHEN 'city' THEN city WHEN 'state' THEN state ELSE country END AS name,
  CASE WHEN level <> 'country' THEN state END AS state, country, count(*) AS count
  FROM place WHERE level IS NOT NULL GROUP BY ALL)"""

_GAZETTEER = """alias AS (SELECT r_name AS alias, r_regionkey AS key,
  CASE WHEN r_regionkey % 2 = 0 THEN 'Region ' || r_name ELSE r_name END AS name_short FROM region),
spot AS (SELECT 'city' AS level, c_mktsegment AS name, length(c_mktsegment) AS key
    FROM (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT 'city', n_name, n_nationkey FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT 'state', n_name, n_nationkey FROM nation WHERE n_nationkey % 5 <> 4
  UNION ALL SELECT 'country', name_short, key FROM alias),
heat AS (SELECT p.level, p.name, p.state, p.country,
  CAST(s.key AS DOUBLE) * 3 - 40 AS lat, CAST(s.key AS DOUBLE) * 7 - 90 AS lon, p.count AS weight,
  p.name || CASE WHEN p.level = 'city' AND p.state IS NOT NULL THEN ', ' || p.state ELSE '' END
    || CASE WHEN p.level <> 'country' AND p.country IS NOT NULL THEN ', ' || p.country ELSE '' END
    || ' (' || CAST(p.count AS VARCHAR) || ' posts)' AS label
  FROM place_count p LEFT JOIN alias a ON p.level = 'country' AND a.alias = p.name
  JOIN spot s ON s.level = p.level AND s.name = coalesce(a.name_short, p.name))"""

_LEVELS = """part AS (SELECT 'city' AS level, city AS name FROM post UNION ALL
  SELECT 'state', state FROM post UNION ALL SELECT 'country', country FROM post),
ranked AS (SELECT level, name, count(*) AS count,
  CAST(row_number() OVER (PARTITION BY level ORDER BY count(*) DESC, name) AS INTEGER) AS rank
  FROM part WHERE name IS NOT NULL AND name <> '' GROUP BY level, name)"""


def _rollup(column: str) -> str:
    return _posts(
        f"""SELECT country, {column}, count(*) AS count,
  CAST(2 - grouping(country) - grouping({column}) AS INTEGER) AS depth
FROM post WHERE country IS NOT NULL GROUP BY ROLLUP (country, {column})"""
    )


_ENTITIES = """gaz AS (SELECT DISTINCT event_type AS ngram, upper(event_type) AS entity, 'ACTION' AS type FROM events
  UNION ALL SELECT * FROM (VALUES ('the hospital', 'Hospital', 'FAC'), ('great victory', 'Victory', 'EVENT'),
    ('sorry for the', 'Condolence', 'PHRASE')) AS v(ngram, entity, type))"""


def _grams(source: str, key: str, text: str, extra: str = "") -> str:
    """CTE ``gram``: 1- to 3-grams of a text column, one row per occurrence."""
    steps = "UNION ALL ".join(
        f"SELECT k, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS ngram "
        f"FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM toks) "
        for n in (1, 2, 3)
    )
    return f"toks AS (SELECT {key} AS k, {_words(text)} AS w FROM {source}), gram AS ({steps})"


_ENTITY_TOKENS = rf"regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_][\pL\pN_'']*')"
_DOC_ENTITIES = f"""WITH item AS (SELECT item_id, {_ENTITY_TOKENS} AS w FROM benchmark),
gaz AS (SELECT DISTINCT w, entity, type FROM (SELECT w, CAST(item_id AS VARCHAR) AS entity, 'ITEM' AS type FROM item UNION ALL
  SELECT list_slice(w, item_id % 5 + 1, item_id % 5 + item_id % 6 + 1), CAST(item_id AS VARCHAR), 'PART' FROM item) WHERE len(w) > 0),
longest AS (SELECT max(len(w)) AS n FROM gaz),
toks AS (SELECT {_ENTITY_TOKENS} AS w FROM documents),
pos AS (SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: list_slice(w, i, i + n - 1))) AS s FROM toks, longest)
SELECT entity, type, count(*) AS count FROM pos JOIN gaz ON s[1] = gaz.w[1] AND list_slice(s, 1, len(gaz.w)) = gaz.w
GROUP BY entity, type"""


_IMPORTS = "imp AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{t}', TIMESTAMP '{at}')" for i, t, at, _ in IMPORTS
) + ") AS v(import_id, topic, imported_at))"

# Which search each import joins, worked out by hand from the rule: #CLICK joins #click; the second
# victory import comes within the hour, the third does not.
_SEARCHES = """search AS (SELECT i.*, CASE import_id WHEN 'i3' THEN 'i1' WHEN 'i5' THEN 'i4' ELSE import_id END AS search_id
  FROM imp i),
stored AS (SELECT s.import_id, s.search_id, s.topic, s.imported_at, p.* FROM search s JOIN post p
  ON contains(lower(p.text), lower(s.topic))),
filled AS (SELECT import_id, search_id, topic, imported_at, count(*) AS n_posts FROM stored GROUP BY ALL)"""


def _store(select: str, *ctes: str) -> str:
    return _posts(select, _IMPORTS, _SEARCHES, *ctes)


def _windows(length_hours: int, slide_hours: int, source: str = "post") -> str:
    """CTE ``win``: every post in each of its windows, aligned to the epoch."""
    steps = length_hours // slide_hours
    return f"""win AS (SELECT w.*, window_start + INTERVAL {length_hours} HOUR AS window_end FROM (
  SELECT p.*, time_bucket(INTERVAL {slide_hours} HOUR, created_at, TIMESTAMP '1970-01-01')
    - i * INTERVAL {slide_hours} HOUR AS window_start
  FROM {source} p, range(0, {steps}) AS r(i)) w)"""


_CRISIS = """disaster_posts, total_posts,
  least(100.0::DOUBLE, coalesce(CAST(disaster_posts AS DOUBLE) / total_posts * 1000.0::DOUBLE, 0)) AS crisis_score"""


def _crisis(source: str, *by: str) -> str:
    keys = ", ".join(by)
    return f"""SELECT *, CASE WHEN crisis_score > 75 THEN 'Extreme' WHEN crisis_score > 55 THEN 'High'
  WHEN crisis_score > 25 THEN 'Moderate' ELSE 'Normal' END AS alert
FROM (SELECT {keys}, {_CRISIS} FROM (SELECT {keys}, count(*) FILTER (WHERE sentiment = 'Disaster') AS disaster_posts,
  count(*) AS total_posts FROM {source} GROUP BY {keys}))"""


_SHARE = "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share"

_DOC_CLEAN = f"doc AS (SELECT doc_id, lang, {_clean('text')} AS cleaned_text FROM documents)"

_LETTERS = r"[\pL\p{Nl}\p{No}_]+"

# Columns that one of the header sets lacks are null in its posts.
_MISSING = ", ".join(
    f"CASE WHEN idx % {len(HEADER_SETS)} IN ({', '.join(str(i) for i, h in enumerate(HEADER_SETS) if header in h)}) THEN {name} END AS {name}"
    for name, header in HEADERS.items()
    if any(header not in h for h in HEADER_SETS)
)

_FEED_SEARCH = """SELECT post_id, text, created_at, sentiment{} FROM post
WHERE regexp_matches(lower(text), 'service|victory') AND list_contains(tags, 'click')
  AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""

_LARGE_LEXICON = f"""lexicon AS (SELECT word, CAST(round((length(word) * 37 % 21 - 10) / 10.0::DOUBLE * 1000000000) AS BIGINT) AS units
  FROM (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents))"""

ORACLE_SQL: dict[str, str] = {
    "normalise_posts": f"WITH {_RAW},\n{_NORM}\nSELECT * EXCLUDE (idx) FROM norm",
    "clean_text": _raw(f"SELECT idx, {_clean('text_')} AS cleaned_text FROM raw"),
    "clean_documents": f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS length
FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)""",
    "sentiment_class": _posts("SELECT post_id, sentiment FROM post"),
    "sentiment_class_by_join": _posts("SELECT post_id, sentiment FROM post"),
    "document_sentiment": f"""WITH {_LEXICON}, {_DOC_CLEAN}, {_polarity('doc', 'doc_id', 'cleaned_text')}
SELECT lang, coalesce({_keyword('cleaned_text')}, {_polar('polarity')}) AS sentiment, count(*) AS count
FROM doc LEFT JOIN pol ON k = doc_id GROUP BY ALL""",
    "conversation_sentiment": f"""WITH {_LEXICON},
doc AS (SELECT conv_id || '/' || turn AS id, role, {_clean('text')} AS cleaned_text FROM conversations),
{_polarity('(SELECT DISTINCT id, cleaned_text FROM doc)', 'id || cleaned_text', 'cleaned_text')}
SELECT role, coalesce({_keyword('cleaned_text')}, {_polar('polarity')}) AS sentiment, count(*) AS count
FROM doc LEFT JOIN pol ON k = id || cleaned_text GROUP BY ALL""",
    "conversation_sentiment_by_join": "",
    "whole_word_sentiment": f"""WITH {_DOC_CLEAN}, found AS (SELECT doc_id, CASE """
    + " ".join(
        rf"WHEN regexp_matches(lower(cleaned_text), '\b(?:{'|'.join(ws)})\b') THEN '{name}'"
        for name, ws in (("Disaster", DISASTER_WORDS), ("Happy", HAPPY_WORDS), ("Sad", SAD_WORDS))
    )
    + " ELSE 'Neutral' END AS sentiment FROM doc) SELECT * FROM found",
    "lexicon_polarity": f"""WITH {_LEXICON}, {_polarity('documents', 'doc_id', 'text')}
SELECT doc_id, polarity FROM documents LEFT JOIN pol ON k = doc_id""",
    "lexicon_polarity_by_join": f"""WITH {_LEXICON}, {_polarity('documents', 'doc_id', 'text')}
SELECT doc_id, polarity FROM documents LEFT JOIN pol ON k = doc_id""",
    "hashtag_bag": _raw(f"SELECT idx, array_to_string({_BAG}, '|') AS hashtags FROM raw"),
    "parse_location": _raw(f"SELECT idx, {_location('location_')} FROM raw"),
    "date_parts": _posts("SELECT post_id, created_at, year, month, day, hour FROM post"),
    "enrich_posts": _posts("SELECT * EXCLUDE (tags), array_to_string(tags, '|') AS hashtags FROM post"),
    "csv_posts": f"WITH {_RAW},\n{_NORM}\nSELECT * EXCLUDE (idx) FROM norm",
    "time_forms": "SELECT event_id, CASE event_id % "
    + str(len(TIME_FORMS))
    + " ".join(f" WHEN {i} THEN date_trunc('{unit}', ts)" for i, (_, unit) in enumerate(TIME_FORMS))
    + " END AS read_ts, false AS unreadable FROM events",
    "csv_mixed_headers": f"""WITH {_RAW.replace('raw AS', 'raw0 AS', 1)},
raw AS (SELECT * REPLACE ({_MISSING}) FROM raw0),
{_NORM}
SELECT * EXCLUDE (idx) FROM norm""",
    "csv_split_records": "SELECT doc_id, md5(nullif(text, '')) AS digest FROM documents",
    "required_column": """SELECT header, CASE WHEN header <> 'Message' THEN n ELSE 0 END AS posts,
  CASE WHEN header = 'Message' THEN 'the input needs a text column with the post content' END AS refusal
FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['text', 'Text', 'Tweet', 'Tweet-Text', 'Message']) AS header)""",
    "refresh_periods": """SELECT DISTINCT (event_id % 140)::INTEGER AS minutes, event_id % 140 BETWEEN 15 AND 120 AS accepted
FROM events""",
    "topic_filter": _raw(
        r"SELECT idx, text_ AS text FROM raw WHERE regexp_matches(lower(text_), 'near the|#k1[23]\b')"
    ),
    "topic_filter_literal": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the ')",
    "posts_search": _posts(_FEED_SEARCH.format("")),
    "sentiment_counts": _posts(f"SELECT sentiment, count(*) AS count, {_SHARE} FROM post GROUP BY sentiment"),
    "sentiment_metrics": _posts(
        "SELECT 'sentiment_' || sentiment AS metric, CAST(count(*) AS VARCHAR) AS value FROM post GROUP BY sentiment"
    ),
    "sentiment_metrics_read": _posts("SELECT sentiment, count(*) AS count FROM post GROUP BY sentiment"),
    "key_metrics": _posts(
        """SELECT count(*) AS total_posts, count(*) FILTER (WHERE sentiment = 'Positive') AS positive_posts,
  round_even(avg(retweet_count), 1) AS avg_retweets, count(DISTINCT platform) AS platforms FROM post"""
    ),
    "platform_distribution": _posts(f"SELECT platform, count(*) AS count, {_SHARE} FROM post GROUP BY platform"),
    "hourly_volume": _posts(
        "SELECT date_trunc('hour', created_at) AS hour, count(*) AS count FROM post GROUP BY date_trunc('hour', created_at)"
    ),
    "top_hashtags": _posts(
        """SELECT hashtag, count(*) AS count FROM (SELECT unnest(tags) AS hashtag FROM post)
GROUP BY hashtag ORDER BY count DESC, hashtag LIMIT 10"""
    ),
    "top_users": _posts(
        f"""SELECT username, count(post_id) AS post_count, {_BIG('sum(retweet_count)')} AS retweets
FROM post GROUP BY username ORDER BY post_count DESC, username LIMIT 10"""
    ),
    "top_influencers": _posts(
        """SELECT username, user_followers FROM (SELECT username, user_followers,
  row_number() OVER (PARTITION BY username ORDER BY user_followers DESC) AS rn FROM post)
WHERE rn = 1 ORDER BY user_followers DESC, username LIMIT 10"""
    ),
    "engagement_points": _posts("SELECT retweet_count, like_count, sentiment, text FROM post"),
    "engagement_bins": _posts(
        f"""SELECT sentiment, {_BIG('floor(log10(retweet_count))')} AS retweet_bin,
  {_BIG('floor(log10(like_count))')} AS like_bin, count(*) AS count
FROM post WHERE retweet_count > 0 AND like_count > 0 GROUP BY ALL"""
    ),
    "crisis_score": _posts(
        _crisis("topic_post", "topic"),
        "topic_post AS (SELECT t.topic, p.sentiment FROM post p JOIN (VALUES "
        + ", ".join(f"('{n}', '{p}')" for n, p in CRISIS_TOPICS.items())
        + ") AS t(topic, pattern) ON regexp_matches(lower(p.text), t.pattern))",
    ),
    "crisis_by_platform": _posts(_crisis("post", "platform")),
    "disaster_sample": _posts(
        """SELECT text, sentiment, platform FROM (SELECT * FROM post WHERE sentiment = 'Disaster'
ORDER BY created_at, post_id LIMIT 15)"""
    ),
    "entity_counts": _posts(
        """SELECT entity, type, count(*) AS count FROM gram JOIN gaz USING (ngram)
GROUP BY entity, type ORDER BY count DESC, entity, type LIMIT 20""",
        _ENTITIES,
        _grams("post", "post_id", "cleaned_text"),
    ),
    "entity_matches": _posts(
        "SELECT k AS post_id, entity, type FROM gram JOIN gaz USING (ngram)",
        _ENTITIES,
        _grams("post", "post_id", "cleaned_text"),
    ),
    "document_entities": _DOC_ENTITIES,
    "document_entities_by_join": _DOC_ENTITIES,
    "entity_plug_in": r"""SELECT entity, 'CAPITALS' AS type, count(*) AS count
FROM (SELECT unnest(regexp_extract_all(text, '(?:^|[^\pL\pN_])([A-Z]{2,}(?:[^\pL\pN_]+[A-Z]{2,})*)(?:$|[^\pL\pN_])', 1)) AS run
  FROM documents), unnest(regexp_extract_all(run, '[A-Z]+')) AS u(entity) GROUP BY entity""",
    "word_frequency": _posts(
        f"""SELECT word, count(*) AS count FROM (SELECT unnest({_words('cleaned_text')}) AS word FROM post)
WHERE word NOT IN ({_list(STOPWORDS)}) GROUP BY word ORDER BY count DESC, word LIMIT 200"""
    ),
    "document_words": f"""WITH corpus AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
stop AS (SELECT DISTINCT unnest({_words('text')}) AS word FROM benchmark),
word AS (SELECT unnest({_words('text')}) AS word FROM corpus)
SELECT word, count(*) AS count FROM word WHERE word NOT IN (SELECT word FROM stop)
GROUP BY word ORDER BY count DESC, word LIMIT 200""",
    "topic_terms": f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents FROM tok
WHERE length(term) BETWEEN 2 AND 15 AND NOT starts_with(term, '_') GROUP BY term""",
    "topic_model_input": f"""SELECT doc_id, term, count(*) AS count
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS term FROM documents)
WHERE length(term) BETWEEN 2 AND 15 AND NOT starts_with(term, '_') GROUP BY doc_id, term""",
    "topic_model_fit": """SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS in_range, true AS falling,
  true AS known FROM range(0, 3) AS a(t), range(1, 11) AS b(r)""",
    "topic_of_posts": f"""SELECT DISTINCT doc_id, 3 AS topics, true AS adds_up, true AS positive, true AS same
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS term FROM documents)
WHERE length(term) BETWEEN 2 AND 15 AND NOT starts_with(term, '_')""",
    "place_counts": _posts("SELECT * FROM place_count", _PLACES),
    "place_counts_parity": _posts(
        "SELECT * FROM place_count WHERE name IS NOT NULL AND state IS NOT NULL AND country IS NOT NULL", _PLACES
    ),
    "standard_countries": _posts(
        """SELECT country, count(*) AS count,
  coalesce(CASE WHEN r_regionkey % 2 = 0 THEN 'Region ' || r_name ELSE r_name END, country) AS name_short
FROM post LEFT JOIN region ON r_name = country WHERE country IS NOT NULL AND country <> ''
GROUP BY country, r_regionkey, r_name"""
    ),
    "heat_points": _posts("SELECT * FROM heat", _PLACES, _GAZETTEER),
    "map_centre": _posts(
        "SELECT coalesce(avg(lat), 20.0) AS lat, coalesce(avg(lon), 0.0) AS lon FROM heat", _PLACES, _GAZETTEER
    ),
    "top_place": _posts("SELECT level, name, count FROM ranked WHERE rank = 1", _LEVELS),
    "place_breakdown": _posts("SELECT * FROM ranked WHERE rank <= 10", _LEVELS),
    "country_counts": _posts(
        "SELECT country, count(*) AS count FROM post WHERE country IS NOT NULL AND country <> '' GROUP BY country"
    ),
    "platform_by_country": _rollup("platform"),
    "sentiment_by_country": _rollup("sentiment"),
    "stored_posts": _store(
        """SELECT import_id, post_id, cleaned_text, created_at, sentiment, platform,
  array_to_string(tags, '|') AS hashtags FROM stored WHERE lower(topic) = '#click'"""
    ),
    "stored_search": _store(
        """SELECT import_id, post_id, created_at, platform FROM stored WHERE lower(topic) = '#click'
  AND contains(lower(text), 'words') AND list_contains(tags, 'k3')
  AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
UNION ALL SELECT import_id, post_id, created_at, platform FROM stored WHERE lower(topic) = '#click'
  AND platform = 'Bluesky' AND created_at >= TIMESTAMP '2024-01-28 00:00:00'"""
    ),
    "stored_posts_latest": _store(
        """SELECT import_id, post_id, sentiment FROM stored WHERE topic = 'victory'
  AND search_id = (SELECT search_id FROM filled WHERE topic = 'victory' ORDER BY imported_at DESC LIMIT 1)"""
    ),
    "stored_hashtags": _store(
        """SELECT hashtag, count(*) AS count FROM (SELECT unnest(tags) AS hashtag FROM stored WHERE lower(topic) = '#click')
GROUP BY hashtag ORDER BY count DESC, hashtag LIMIT 10"""
    ),
    "stored_hashtags_parity": _store(
        """SELECT hashtag, count(*) AS count FROM (SELECT import_id, unnest(tags) AS hashtag FROM stored
  WHERE lower(topic) = '#click') GROUP BY import_id, hashtag ORDER BY count DESC, hashtag, import_id LIMIT 10"""
    ),
    "stored_sentiment": _store(
        f"SELECT sentiment, count(*) AS count, {_SHARE} FROM stored WHERE lower(topic) = '#click' GROUP BY sentiment"
    ),
    "stored_metrics": _store(
        """SELECT 'sentiment_' || sentiment AS metric, CAST(count(*) AS VARCHAR) AS value
FROM stored WHERE lower(topic) = '#click' GROUP BY import_id, sentiment"""
    ),
    "stored_positive_parity": _store(
        """SELECT count(*) AS positive_posts FROM stored WHERE import_id = 'i1' AND sentiment = 'Positive'"""
    ),
    "latest_import": _store(
        """SELECT search_id FROM (SELECT search_id, lower(topic) AS key, min(imported_at) AS began FROM filled
  GROUP BY search_id, lower(topic)) WHERE key IN ('#click', 'victory')
QUALIFY row_number() OVER (PARTITION BY key ORDER BY began DESC) = 1"""
    ),
    "searches": _store(
        f"""SELECT search_id, lower(topic) AS topic_key, arg_min(topic, imported_at) AS topic,
  min(imported_at) AS searched_at, 'csv' AS source, 'multiple' AS platform, {_BIG('sum(n_posts)')} AS n_posts
FROM filled GROUP BY search_id, lower(topic)"""
    ),
    "search_history": _store(
        """SELECT topic, max(began) AS last_searched FROM (SELECT search_id, arg_min(topic, imported_at) AS topic,
  min(imported_at) AS began FROM filled GROUP BY search_id) GROUP BY topic ORDER BY last_searched DESC, topic LIMIT 10"""
    ),
    "import_summary": _store("SELECT import_id, topic, imported_at, n_posts FROM filled"),
    "recent_search": _store(
        """SELECT search_id FROM (SELECT search_id, topic, min(imported_at) AS began FROM filled GROUP BY search_id, topic)
WHERE topic IN ('#click', 'victory') AND began > TIMESTAMP '2024-02-01 02:00:00'"""
    ),
    "known_topics": _store(
        """SELECT topic, count(*) > 0 AND topic IN (SELECT lower(topic) FROM filled) AS known
FROM (SELECT '#' || event_type AS topic FROM events) GROUP BY topic"""
    ),
    "csv_import": _posts(
        """SELECT post_id, sentiment, city, country, like_count FROM post
WHERE regexp_matches(lower(text), 'near|service')"""
    ),
    "stream_volume": _posts(
        "SELECT window_start, window_end, count(*) AS count FROM win GROUP BY ALL", _windows(1, 1)
    ),
    "stream_hashtags": _posts(
        """SELECT window_start, window_end, hashtag, count(*) AS count
FROM (SELECT window_start, window_end, unnest(tags) AS hashtag FROM win) GROUP BY ALL""",
        _windows(12, 6),
    ),
    "stream_crisis": _posts(_crisis("win", "window_start", "window_end"), _windows(24, 24)),
    "stream_unique_posts": f"""WITH {_RAW},\n{_NORM}
SELECT post_id, created_at, coalesce({_keyword(_clean('text'))}, 'Neutral') AS sentiment FROM norm""",
    "stream_import": _posts("SELECT post_id, sentiment, platform, like_count FROM post"),
    "stream_feed_posts": _posts(_FEED_SEARCH.format(", city, state, country")),
    "stream_large_lexicon": _posts("SELECT post_id, sentiment FROM post").replace(_LEXICON, _LARGE_LEXICON, 1),
    "repeated_import": _posts(
        """SELECT * FROM (SELECT 'tags' AS topic, count(*) AS n_posts, 0::BIGINT AS n_tags, 0::BIGINT AS listed FROM post
  WHERE contains(lower(text), '#click') UNION ALL SELECT 'back', count(*), sum(len(tags))::BIGINT, sum(len(tags))::BIGINT
  FROM post WHERE contains(lower(text), '#click'))"""
    ),
    "concurrent_imports": _posts(
        f"""SELECT topic, 3::BIGINT AS imports, 1::BIGINT AS searches, {_BIG('3 * count(*)')} AS n_posts,
  {_BIG('3 * count(*)')} AS stored FROM post, (SELECT unnest(['#click', 'hospital', 'victory', 'service']) AS topic)
WHERE contains(lower(text), topic) GROUP BY topic"""
    ),
    "failed_import": _posts("SELECT 'a' AS import_id, post_id, sentiment FROM post WHERE contains(lower(text), 'hospital')"),
}
ORACLE_SQL["conversation_sentiment_by_join"] = ORACLE_SQL["conversation_sentiment"]
