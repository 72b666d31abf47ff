"""DuckDB SQL twins of the fixtures and queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's
pre-registered views.  RE2 has no look-behind and no back-references, so a
few operators are phrased differently (marker-then-split, list lambdas);
the results must still be equal value for value.
"""

from __future__ import annotations

# Python's str.split()/strip() whitespace (str.isspace), as RE2 escapes.
_WS = "".join(f"\\x{{{ord(c):04X}}}" for c in map(chr, range(0x3001)) if c.isspace())
WS = f"[{_WS}]"
NWS = f"[^{_WS}]"
LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC_26 = "أبةدإفغهآجكلمنىپقرستَوُئيز"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SPLIT = f"""split_parts AS (
  SELECT doc_id, n_chars, unnest(range(len(parts))) AS p, unnest(parts) AS piece
  FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"""

SENT_RAW = """sent_raw AS (SELECT doc_id, CAST(p AS INTEGER) AS pos, piece AS sentence FROM split_parts)"""

SENT_CLEAN = f"""sent_clean AS (
  SELECT doc_id, pos, sentence FROM (
    SELECT doc_id, CAST(p AS INTEGER) AS pos,
           regexp_replace(piece, '^{WS}+|{WS}+$', '', 'g') AS sentence FROM split_parts)
  WHERE sentence <> '')"""

SENT_UNTRIMMED = f"""sent_untrimmed AS (
  SELECT doc_id, CAST(p AS INTEGER) AS pos, piece AS sentence FROM split_parts
  WHERE regexp_matches(piece, '{NWS}'))"""

GOLD = """gold AS (SELECT doc_id, CAST(1 + (7 * doc_id + n_chars) % 19 AS INTEGER) AS label FROM documents)"""

LEX = f"""lex AS (
  SELECT lemma, CAST(1 + (length(lemma) - 1) % 5 AS DOUBLE) AS score FROM (
    SELECT DISTINCT lower(t) AS lemma FROM (
      SELECT unnest(regexp_extract_all(text, '{NWS}+')) AS t FROM documents)
  ) WHERE length(lemma) % 7 <> 0)"""

TOK_CLEAN = f"""tok AS (
  SELECT doc_id, pos, n_chars, unnest(range(len(ts))) AS tpos, unnest(ts) AS token FROM (
    SELECT doc_id, pos, length(sentence) AS n_chars,
           regexp_extract_all(sentence, '{NWS}+') AS ts FROM sent_clean))"""

SUMS = """sums AS (
  SELECT t.doc_id, t.pos, t.n_chars,
         count(t.token) AS n_words,
         sum(length(t.token)) AS sum_len,
         sum(coalesce(l.score, 3.0)) AS sum_diff,
         max(coalesce(l.score, 3.0)) AS max_diff,
         count(*) FILTER (WHERE coalesce(l.score, 3.0) > 4) AS n_hard,
         count(*) FILTER (WHERE l.score IS NULL) AS n_oov
  FROM tok t LEFT JOIN lex l ON lower(t.token) = l.lemma
  GROUP BY t.doc_id, t.pos, t.n_chars)"""

CASED_LEX = f"""lex AS (
  SELECT lemma, CAST(1 + (length(lemma) + 4) % 5 AS DOUBLE) AS score FROM (
    SELECT DISTINCT t AS lemma FROM (SELECT unnest(regexp_extract_all(text, '{NWS}+')) AS t FROM documents))
  WHERE length(lemma) % 7 <> 0)"""

CASED_SUMS = SUMS.replace("lower(t.token) = l.lemma", "t.token = l.lemma")

RAW = """scored AS (
  SELECT doc_id, pos,
         CASE WHEN n_words > 0 THEN
           CAST(4 * sum_len + 8.0 * sum_diff + 24 * n_hard + n_words * n_words - 32 * n_words AS DOUBLE)
           / CAST(4 * n_words AS DOUBLE) ELSE 0.0 END AS raw
  FROM sums)"""

DOC_LEVEL = """doc_level AS (
  SELECT doc_id, CAST(least(greatest(round_even(max(raw), 0), 0), 18) + 1 AS INTEGER) AS level
  FROM scored GROUP BY doc_id)"""

SENT_LEVEL = """sent_level AS (
  SELECT doc_id, pos, CAST(least(greatest(round_even(raw, 0), 0), 18) + 1 AS INTEGER) AS level
  FROM scored)"""

FILLED = """filled AS (
  SELECT d.doc_id, CAST(coalesce(p.level, 1) AS INTEGER) AS level
  FROM documents d LEFT JOIN doc_level p ON d.doc_id = p.doc_id)"""

#: Only the documents in ``labels`` are scored; the others get the fill value.
FILLED_REST = """filled AS (
  SELECT d.doc_id, CAST(coalesce(p.level, 1) AS INTEGER) AS level
  FROM documents d LEFT JOIN (
    SELECT doc_id, level FROM doc_level WHERE doc_id IN (SELECT doc_id FROM labels)) p
  ON d.doc_id = p.doc_id)"""

DOC_FLOW = (SPLIT, SENT_CLEAN, LEX, TOK_CLEAN, SUMS, RAW, DOC_LEVEL)


def level_expr(x: str) -> str:
    return f"CAST(least(greatest(round_even({x}, 0), 0), 18) + 1 AS INTEGER)"


def sparse_pairs(table: str = "lineitem") -> str:
    return f"""pairs AS (
  SELECT CAST([1, 2, 5, 9, 19][(l_orderkey % 5) + 1] AS BIGINT) AS gold,
         CAST([1, 3, 5, 9, 18][((l_orderkey + l_linenumber) % 5) + 1] AS BIGINT) AS pred
  FROM {table})"""


DOC_PAIRS = """pairs AS (
  SELECT CAST(g.label AS BIGINT) AS gold, CAST(f.level AS BIGINT) AS pred
  FROM filled f JOIN gold g ON f.doc_id = g.doc_id)"""


def kappa_select(observed: bool, scale: str = "") -> str:
    """QWK over ``pairs(gold, pred)`` from exact HUGEINT moments."""
    if observed:
        ranks = """labs AS (
  SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS HUGEINT) AS r
  FROM (SELECT gold AS v FROM pairs UNION SELECT pred AS v FROM pairs)),
ranked AS (SELECT ga.r AS a, pb.r AS b FROM pairs JOIN labs ga ON pairs.gold = ga.v
           JOIN labs pb ON pairs.pred = pb.v)"""
    else:
        ranks = "ranked AS (SELECT CAST(gold AS HUGEINT) AS a, CAST(pred AS HUGEINT) AS b FROM pairs)"
    return ranks + """,
mom AS (SELECT CAST(count(*) AS HUGEINT) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa,
               sum(b * b) AS sbb, sum(a * b) AS sab FROM ranked),
kap AS (SELECT n, n * (saa + sbb - 2 * sab) AS num, n * (saa + sbb) - 2 * sa * sb AS den FROM mom)"""


KAPPA_EXPR = "CASE WHEN den <> 0 THEN 1.0 - CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END"


DIAC = r"[\x{064B}-\x{0652}\x{0670}\x{0640}]"
ARABIC = f"""arabic AS (
  SELECT doc_id, translate(lower(replace(text, 'ee', 'eeeee')), '{LATIN}', '{ARABIC_26}') AS text
  FROM documents)"""


def collapse_sql(cs: str) -> str:
    """Runs of three or more equal characters (newline excepted) -> one;
    ``cs`` is the text as a list of characters."""
    return f"""array_to_string(list_filter({cs}, lambda c, i:
      NOT (c <> chr(10) AND i > 1 AND {cs}[i - 1] = c AND (
        (i > 2 AND {cs}[i - 2] = c) OR (i < len({cs}) AND {cs}[i + 1] = c)))), '')"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


NORM_STEPS = f"""steps AS (
  SELECT doc_id, t_dediac, t_alef, t_yaa_taa, t_elongation,
         {strip_sql(f"regexp_replace(regexp_replace(t_elongation, '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '{WS}+', ' ', 'g')")} AS t_punct
  FROM (
    SELECT doc_id, t_dediac, t_alef, t_yaa_taa, {collapse_sql('cs')} AS t_elongation FROM (
     SELECT *, regexp_extract_all(t_yaa_taa, '(?s).') AS cs FROM (
      SELECT doc_id, t_dediac, t_alef, translate(t_alef, 'ىة', 'يه') AS t_yaa_taa FROM (
        SELECT doc_id, t_dediac, translate(t_dediac, 'أإآ', 'ااا') AS t_alef FROM (
          SELECT doc_id, regexp_replace(text, '{DIAC}', '', 'g') AS t_dediac FROM arabic))))))"""

SENT_PUNCT = f"""sent_punct AS (
  SELECT doc_id, CAST(p AS INTEGER) AS pos, sentence FROM (
    SELECT doc_id, unnest(range(len(kept))) AS p, unnest(kept) AS sentence FROM (
      SELECT doc_id, list_filter(list_transform(string_split(
               regexp_replace(text, '([.!?؟؛\\n]){WS}*', '\\1' || chr(1), 'g'), chr(1)),
               lambda x: {strip_sql('x')}), lambda x: x <> '') AS kept
      FROM documents WHERE text IS NOT NULL)))"""

LIST_DOCS = """list_docs AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text WHEN doc_id % 10 = 7 THEN '[]'
                      ELSE CAST(to_json(string_split(text, chr(10))) AS VARCHAR) END AS lit
  FROM documents)"""

SENT_LIST = """sent_list AS (
  SELECT doc_id, CAST(p AS INTEGER) AS pos, sentence FROM (
    SELECT doc_id, unnest(range(len(arr))) AS p, unnest(arr) AS sentence FROM (
      SELECT doc_id, CASE WHEN json_valid(lit) THEN from_json(lit, '["VARCHAR"]') END AS arr
      FROM list_docs))
  WHERE sentence IS NOT NULL)"""

POS_RULE = "CASE length(lemma) % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'prt' END"

ANALYSES = f"""analyses_all AS (
  SELECT lemma AS word,
         CASE WHEN starts_with(lemma, 're') THEN 're+_' || substr(lemma, 3)
              WHEN ends_with(lemma, 'ed') THEN substr(lemma, 1, length(lemma) - 2) || '_+ed'
              ELSE lemma END AS d3tok,
         lemma AS lex, {POS_RULE} AS pos, 0.9 AS score FROM lex
  UNION ALL
  SELECT lemma, lemma, lemma, 'noun', 0.1 FROM lex),
analyses AS (
  SELECT word, d3tok, lex, pos FROM analyses_all
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, d3tok DESC, lex DESC, pos DESC) = 1)"""

LEX_LP = f"""lex_lp AS (SELECT lemma || '#' || {POS_RULE} AS lemma_pos, score FROM lex)"""

WORD_TOKENS = f"[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^{_WS}\\p{{L}}\\p{{M}}\\p{{N}}_]"

WTOK = f"""wtok AS (
  SELECT doc_id, pos, unnest(range(len(ts))) AS tpos, unnest(ts) AS token FROM (
    SELECT doc_id, pos, regexp_extract_all(sentence, '{WORD_TOKENS}') AS ts FROM sent_clean))"""

MORPH = f"""morph AS (
  SELECT w.doc_id, w.pos, w.tpos, w.token, a.lex, a.pos AS tag,
         CASE WHEN a.d3tok IS NULL OR NOT regexp_matches(a.d3tok, '{NWS}') THEN w.token
              ELSE replace(replace(regexp_replace(a.d3tok, '{DIAC}', '', 'g'), '_+', ' +'), '+_', '+ ') END AS form
  FROM wtok w LEFT JOIN analyses a ON lower(w.token) = a.word),
morph_scored AS (
  SELECT m.*, l.score FROM morph m LEFT JOIN lex_lp l
    ON CASE WHEN m.lex IS NOT NULL AND m.tag IS NOT NULL
            THEN regexp_replace(m.lex, '{DIAC}', '', 'g') || '#' || m.tag END = l.lemma_pos)"""

SCORE_AGGS = """CASE WHEN count(score) > 0 THEN CAST(sum(score) AS DOUBLE) / CAST(count(score) AS DOUBLE) ELSE 0.0 END AS avg_readability,
  coalesce(max(score), 0.0) AS max_readability"""


WIDE = """wide AS (
  SELECT conv_id, turn // 3 AS block, max(CASE WHEN turn % 3 = 0 THEN text END) AS L3,
         max(CASE WHEN turn % 3 = 1 THEN text END) AS L4, max(CASE WHEN turn % 3 = 2 THEN text END) AS L5
  FROM conversations GROUP BY conv_id, turn // 3)"""


def graded_long(l3: int, l4: int, l5: int) -> str:
    return f"""graded AS (
  SELECT conv_id, block, level_name, text,
         CAST(CASE level_name WHEN 'L3' THEN {l3} WHEN 'L4' THEN {l4} WHEN 'L5' THEN {l5} END AS INTEGER) AS label
  FROM (UNPIVOT wide ON L3, L4, L5 INTO NAME level_name VALUE text))"""


TEMPLATE = "هذه كلمة بسيطة: "
LEX_SENTENCES = f"""lex_sent AS (
  SELECT word, '{TEMPLATE}' || word || '.' AS text,
         CAST(CASE readability WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 11 WHEN 4 THEN 15 WHEN 5 THEN 18 END AS INTEGER) AS label
  FROM (SELECT split_part(lemma || '#' || {POS_RULE}, '#', 1) AS word, CAST(score AS INTEGER) AS readability FROM lex))"""

GRADE = """grade AS (
  SELECT item_id, text, TRY_CAST(replace('G' || CAST(1 + item_id % 12 AS VARCHAR), 'G', '') AS INTEGER) AS label
  FROM benchmark)"""


def stratified_sql(src: str, id_expr: str, label: str, frac: float = 0.15) -> str:
    """Exact stratified dev selection: ceil(f·N) rows, largest remainder per
    class (ties by label), classes with one row stay in train."""
    return f"""cls AS (SELECT {label} AS label, count(*) AS n FROM {src} GROUP BY {label}),
tot AS (SELECT sum(n) AS total, CAST(ceil(CAST({frac} AS DOUBLE) * sum(n)) AS BIGINT) AS n_dev FROM cls),
q0 AS (SELECT label, n, CASE WHEN n < 2 THEN 0 ELSE ((SELECT n_dev FROM tot) * n) // (SELECT total FROM tot) END AS q,
              CASE WHEN n < 2 THEN NULL ELSE ((SELECT n_dev FROM tot) * n) % (SELECT total FROM tot) END AS rem,
              (SELECT n_dev FROM tot) AS n_dev FROM cls),
q1 AS (SELECT label, q + CASE WHEN rem IS NOT NULL AND
              row_number() OVER (ORDER BY rem IS NULL, rem DESC, label) <= n_dev - (SELECT sum(q) FROM q0)
              THEN 1 ELSE 0 END AS quota FROM q0),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || {id_expr})) AS rk
           FROM {src} s),
split AS (SELECT r.*, CASE WHEN r.rk <= q1.quota THEN 'dev' ELSE 'train' END AS split
          FROM ranked r JOIN q1 ON r.{label} = q1.label)"""


# ------------------------------------------------------------------ fitted models


def gauss(name: str, src: str, keys: str = "", width: str = "len(m)") -> str:
    """CTEs that solve ``src``'s systems ``m`` (rows of an augmented matrix) by
    Gauss-Jordan elimination; ``name`` holds the keys and the solution ``x``."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_steps AS (
  SELECT {k}1 AS k, m FROM {src}
  UNION ALL
  SELECT {k}k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k
      THEN list_transform(m[k], lambda v: v / m[k][k])
      ELSE list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
  FROM {name}_steps WHERE k <= {width}),
{name} AS (SELECT {k}list_transform(m, lambda r: r[len(r)]) AS x FROM {name}_steps WHERE k = len(m) + 1)"""


#: Noisy gold level of a sentence that its words explain in part.
NOISY_GOLD = "least(greatest(n_words // 4 + (7 * doc_id + 3 * pos) % 5, 1), 19)"
FOLD = "CAST(('0x' || substr(md5('42:' || doc_id), 1, 8)) AS BIGINT) % 5"

ORDINAL_DATA = f"""data AS (
  SELECT doc_id, pos, CAST({NOISY_GOLD} AS INTEGER) AS gold, {FOLD} AS fold,
         [CAST(n_chars AS DOUBLE), CAST(n_words AS DOUBLE), CAST(sum_len AS DOUBLE) / CAST(n_words AS DOUBLE),
          CAST(sum_diff AS DOUBLE) / CAST(n_words AS DOUBLE), CAST(max_diff AS DOUBLE), CAST(n_hard AS DOUBLE),
          CAST(n_oov AS DOUBLE) / CAST(n_words AS DOUBLE)] AS x FROM sums)"""


def ordinal_fit(steps: int, reg: float, d: int = 7) -> str:
    """The cumulative-link model of ``data`` (fold 0 left out): ``fitted(w,
    cuts)``, ``labs(gold, y)`` and ``scaled(doc_id, pos, gold, fold, z)``."""
    parts = [f"""stat AS (
  SELECT list(a ORDER BY i) AS a, list(CASE WHEN s = 0 THEN 1.0 ELSE s END ORDER BY i) AS s FROM (
    SELECT i, avg(x[i]) AS a, stddev_pop(x[i]) AS s FROM data, range(1, {d + 1}) t(i) WHERE fold <> 0 GROUP BY i))""", """scaled AS MATERIALIZED (
  SELECT doc_id, pos, gold, fold, list_transform(range(1, len(x) + 1), lambda i: (x[i] - a[i]) / s[i]) AS z FROM data, stat)""", """labs AS (
  SELECT gold, row_number() OVER (ORDER BY gold) AS y, n, sum(n) OVER (ORDER BY gold) AS below, sum(n) OVER () AS total
  FROM (SELECT gold, count(*) AS n FROM data WHERE fold <> 0 GROUP BY gold))""", "kk AS (SELECT max(y) AS k FROM labs)", """train AS MATERIALIZED (
  SELECT z, y FROM scaled JOIN labs USING (gold) WHERE fold <> 0)""", f"""p0 AS (
  SELECT list(ln((below + 0.5) / (total - below + 0.5)) ORDER BY y) AS cuts, [{', '.join(['0.0'] * d)}] AS w
  FROM labs, kk WHERE y < k)"""]
    for t in range(steps):
        parts.append(f"""r{t} AS MATERIALIZED (
  SELECT z, y, k, u, l, uu, ll, ul, -(u + l) AS e, uu + 2 * ul + ll AS ee, -(uu + ul) AS eu, -(ul + ll) AS el FROM (
    SELECT z, y, k, a AS u, -b AS l, a2 - a * a AS uu, -b2 - b * b AS ll, a * b AS ul FROM (
      SELECT z, y, k, du / p AS a, dl / p AS b, du * (1 - 2 * fu) / p AS a2, dl * (1 - 2 * fl) / p AS b2 FROM (
        SELECT *, greatest(fu - fl, 1e-12) AS p, fu * (1 - fu) AS du, fl * (1 - fl) AS dl FROM (
          SELECT z, y, k, CASE WHEN y = k THEN 1.0 ELSE 1.0 / (1.0 + exp(eta - cuts[least(y, k - 1)])) END AS fu,
                 CASE WHEN y = 1 THEN 0.0 ELSE 1.0 / (1.0 + exp(eta - cuts[greatest(y - 1, 1)])) END AS fl
          FROM (SELECT z, y, k, cuts, list_sum(list_transform(range(1, {d + 1}), lambda i: w[i] * z[i])) AS eta
                FROM train, kk, p{t}))))))""")
        parts.append(f"""g{t} AS (
  SELECT j AS i, sum(e * z[j]) AS v FROM r{t}, range(1, {d + 1}) t(j) GROUP BY j
  UNION ALL SELECT {d} + y, sum(u) FROM r{t} WHERE y < k GROUP BY y
  UNION ALL SELECT {d} + y - 1, sum(l) FROM r{t} WHERE y > 1 GROUP BY y)""")
        parts.append(f"""half{t} AS (
  SELECT a AS i, b AS j, sum(ee * z[a] * z[b]) AS v FROM r{t}, range(1, {d + 1}) t(a), range(1, {d + 1}) s(b) GROUP BY a, b
  UNION ALL SELECT a, {d} + y, sum(eu * z[a]) FROM r{t}, range(1, {d + 1}) t(a) WHERE y < k GROUP BY a, y
  UNION ALL SELECT a, {d} + y - 1, sum(el * z[a]) FROM r{t}, range(1, {d + 1}) t(a) WHERE y > 1 GROUP BY a, y
  UNION ALL SELECT {d} + y, {d} + y, sum(uu) FROM r{t} WHERE y < k GROUP BY y
  UNION ALL SELECT {d} + y - 1, {d} + y - 1, sum(ll) FROM r{t} WHERE y > 1 GROUP BY y
  UNION ALL SELECT {d} + y - 1, {d} + y, sum(ul) FROM r{t} WHERE y > 1 AND y < k GROUP BY y)""")
        parts.append(f"""h{t} AS (
  SELECT i, j, sum(v) AS v FROM (SELECT * FROM half{t} UNION ALL SELECT j, i, v FROM half{t} WHERE i <> j AND (i <= {d} AND j > {d} OR i > {d}))
  GROUP BY i, j)""")
        parts.append(f"""m{t} AS MATERIALIZED (
  SELECT list(line ORDER BY i) AS m FROM (
    SELECT i, list(v ORDER BY j) AS line FROM (
      SELECT a.i, b.j, CASE WHEN b.j <= {d} + k - 1
               THEN CASE WHEN a.i = b.j AND a.i <= {d} THEN CAST({reg} AS DOUBLE) ELSE 0.0 END - coalesce(h.v, 0.0)
               ELSE coalesce(g.v, 0.0) - CASE WHEN a.i <= {d} THEN {reg} * w[a.i] ELSE 0.0 END END AS v
      FROM kk, p{t}, unnest(range(1, {d} + k)) a(i), unnest(range(1, {d} + k + 1)) b(j)
      LEFT JOIN h{t} h ON h.i = a.i AND h.j = b.j LEFT JOIN (SELECT i, sum(v) AS v FROM g{t} GROUP BY i) g ON g.i = a.i)
    GROUP BY i))""")
        parts.append(gauss(f"x{t}", f"m{t}"))
        parts.append(f"""p{t + 1} AS MATERIALIZED (
  SELECT list_transform(range(1, len(cuts) + 1), lambda i: cuts[i] + x[{d} + i]) AS cuts,
         list_transform(range(1, {d + 1}), lambda i: w[i] + x[i]) AS w FROM p{t}, x{t})""")
    return ",\n".join([*parts, f"fitted AS (SELECT w, cuts FROM p{steps})"])


ORDINAL_LEVELS = """ordinal AS (
  SELECT doc_id, pos, gold, CAST(seen[1 + len(list_filter(cuts, lambda c: c < eta))] AS INTEGER) AS level FROM (
    SELECT doc_id, pos, gold, cuts, list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * z[i])) AS eta
    FROM scaled, fitted), (SELECT list(gold ORDER BY y) AS seen FROM labs))"""


def bayes_levels(texts: str) -> str:
    """Naive Bayes of ``texts(doc_id, pos, text, label, fold)``, fitted without
    fold 0: ``bayes(doc_id, pos, label, fold, level)``."""
    def log(num, den):
        return f"CAST(floor(ln(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)) * 1000000.0 + 0.5) AS BIGINT)"

    return f"""btok AS (
  SELECT doc_id, pos, label, fold, unnest(regexp_extract_all(lower(text), '{NWS}+')) AS word FROM {texts}),
bcount AS (SELECT label, word, count(*) AS n FROM btok WHERE fold <> 0 GROUP BY label, word),
bsize AS (SELECT count(DISTINCT word) AS size FROM bcount),
bclass AS (
  SELECT c.label, {log('c.n', '(sum(c.n) OVER ())')} AS prior, coalesce(t.n, 0) + size AS mass
  FROM (SELECT label, count(*) AS n FROM {texts} WHERE fold <> 0 GROUP BY label) c CROSS JOIN bsize
  LEFT JOIN (SELECT label, sum(n) AS n FROM bcount GROUP BY label) t ON t.label = c.label),
bweight AS (
  SELECT w.word, c.label, {log('(coalesce(b.n, 0) + 1)', 'c.mass')} AS v
  FROM (SELECT DISTINCT word FROM bcount) w CROSS JOIN bclass c LEFT JOIN bcount b ON b.word = w.word AND b.label = c.label),
bscore AS (
  SELECT s.doc_id, s.pos, c.label AS class, c.prior + coalesce(sum(w.v), 0) AS score
  FROM {texts} s CROSS JOIN bclass c LEFT JOIN btok t ON t.doc_id = s.doc_id AND t.pos = s.pos
  LEFT JOIN bweight w ON w.word = t.word AND w.label = c.label GROUP BY s.doc_id, s.pos, c.label, c.prior),
bayes AS (
  SELECT s.doc_id, s.pos, s.label, s.fold, CAST(b.class AS INTEGER) AS level FROM {texts} s JOIN (
    SELECT doc_id, pos, class FROM bscore
    QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, class) = 1) b
  ON b.doc_id = s.doc_id AND b.pos = s.pos)"""


def ridge_vectors(dims: int) -> str:
    """``hyb(vec_id, y, fold, x)``: an intercept, ``dims`` of the embedding's
    entries and the document's seven features, as integers."""
    def whole(x):
        return f"CAST(floor(CAST({x} AS DOUBLE) * 1000.0 + 0.5) AS BIGINT)"

    feats = ["n_chars", "n_words", "CAST(sum_len AS DOUBLE) / CAST(n_words AS DOUBLE)",
             "CAST(sum_diff AS DOUBLE) / CAST(n_words AS DOUBLE)", "max_diff", "n_hard",
             "CAST(n_oov AS DOUBLE) / CAST(n_words AS DOUBLE)"]
    entries = ["1000"] + [whole(f"e.embedding[{i + 1}]") for i in range(dims)]
    entries += [f"coalesce({whole(f)}, 0)" for f in feats]
    return f"""hyb AS MATERIALIZED (
  SELECT e.vec_id, CAST(e.label AS BIGINT) + 1 AS y, {FOLD.replace("doc_id", "vec_id")} AS fold, [{', '.join(entries)}] AS x
  FROM embeddings e LEFT JOIN sums u ON u.doc_id = e.vec_id)"""


def gram_systems(groups: str, regs: list[float]) -> str:
    """``rsys(reg, fold, m)``: scaled ridge systems for every penalty and every
    row of ``groups(fold, i, j, v)``, j one past the last being X'y."""
    table = ", ".join(f"({r})" for r in regs)
    return f"""dim AS (SELECT max(j) - 1 AS d FROM {groups}),
products AS (SELECT fold, i, j, CAST(v AS DOUBLE) AS v FROM {groups}
         UNION ALL SELECT fold, j, i, CAST(v AS DOUBLE) FROM {groups}, dim WHERE i < j AND j <= d),
size AS (SELECT fold, i, CASE WHEN v = 0 THEN 1.0 ELSE sqrt(v) END AS s FROM products WHERE i = j),
rsys AS MATERIALIZED (
  SELECT reg, fold, list(line ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (
    SELECT reg, b.fold, b.i, any_value(a.s) AS s,
           list(b.v / a.s / coalesce(c.s, 1.0) + CASE WHEN b.i = b.j AND b.i > 1 THEN reg ELSE 0.0 END ORDER BY b.j) AS line
    FROM products b JOIN size a ON a.fold = b.fold AND a.i = b.i LEFT JOIN size c ON c.fold = b.fold AND c.i = b.j,
         (VALUES {table}) t(reg) GROUP BY reg, b.fold, b.i) GROUP BY reg, fold),
{gauss('rsol', 'rsys', 'reg, fold, s')},
ridge AS (SELECT CAST(reg AS DOUBLE) AS reg, fold, list_transform(range(1, len(x) + 1), lambda i: x[i] / s[i]) AS w FROM rsol)"""


def gram_of(rows: str, fold: str = "fold") -> str:
    return f"""SELECT {fold} AS fold, i, j, CAST(sum(CAST(x[i] AS HUGEINT) * (CASE WHEN j > len(x) THEN y ELSE x[j] END)) AS HUGEINT) AS v
  FROM {rows}, range(1, 100) a(i), range(1, 101) b(j) WHERE i <= len(x) AND j <= len(x) + 1 AND i <= j GROUP BY 1, i, j"""


DOT = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] AS DOUBLE) * w[i]))"
