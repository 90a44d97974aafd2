"""DuckDB SQL equal to each registered query (tables are DuckDB views).

The SQL is assembled from the same pattern constants as the Spark
expressions (RE2 and Java read them alike, except the tag rule's ``(?d)``
flag, which RE2 does not need).  DuckDB lambdas use ``lambda x: ...``.
"""

from __future__ import annotations

from chronotext.functions import rules
from chronotext.functions import text as tx

MIN_TOKENS = 8
SEG_TOKENS = 400


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(tx.EDGE_SPACE)}, '', 'g')"


def clean(x: str) -> str:
    untag = f"regexp_replace(lower({x}), {_q(tx.TAG_PAIR_RE2)}, '\\1', 'g')"
    return strip(f"replace({untag}, chr(0), '')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {_q(tx.TOKEN)})"


def n_words(x: str) -> str:
    return f"len(list_filter({tokens(f'lower({x})')}, lambda t: regexp_matches(t, {_q(tx.LETTER)})))"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {_q(tx.SENT_END)}, '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def endlines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"


def shape_tag(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, '^\\p{{N}}+$') THEN 'NUM' "
            f"WHEN NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT' "
            f"WHEN regexp_matches({t}, '\\p{{L}}') AND regexp_matches({t}, '\\p{{N}}') THEN 'MIX' "
            f"WHEN length({t}) <= 3 THEN 'FUNC' WHEN length({t}) <= 7 THEN 'WORD' ELSE 'LONG' END")


DOCS = f"""docs AS (
  SELECT doc_id, {clean("coalesce(text, '')")} AS text,
         {strip("coalesce(source, '')")} AS title, {strip("coalesce(lang, '')")} AS epoch,
         {strip("coalesce(lang, '')")} AS language, {strip("coalesce(source, '')")} AS area,
         replace({strip("coalesce(source, '')")}, ' ', '_') AS filename
  FROM documents WHERE {strip("coalesce(text, '')")} <> '')"""

LABELS = "CASE epoch " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in rules.LANG_LABELS.items()) + " END"
LABELLED = f"labelled AS (SELECT *, ({LABELS})::INTEGER AS label FROM docs)"

FRAG_T = 'STRUCT(text VARCHAR, n_tok INTEGER, fs INTEGER, ls INTEGER)'


def _frag(text, n_tok, fs, ls) -> str:
    return f"{{'text': {text}, 'n_tok': ({n_tok})::INTEGER, 'fs': ({fs})::INTEGER, 'ls': ({ls})::INTEGER}}"


def units_cte(name: str = "units") -> str:
    unit = (f"{{'text': s, 'n_words': ({n_words('s')})::INTEGER, "
            f"'n_tok': (len({tokens('s')}))::INTEGER, 'idx': (i - 1)::INTEGER}}")
    return f"""{name} AS (SELECT doc_id, list_transform({sentences('text')}, lambda s, i: {unit}) AS u FROM docs)"""


def merge_expr(u: str, mode: str = "intended", min_tokens: int = MIN_TOKENS) -> str:
    buf = "CASE WHEN acc.buf IS NULL THEN x.text ELSE acc.buf || ' ' || x.text END"
    full = f"acc.bw + x.n_words >= {min_tokens}"
    step = (f"lambda acc, x: CASE WHEN {full} THEN "
            f"{{'done': list_append(acc.done, {_frag(buf, 'acc.bt + x.n_tok', 'coalesce(acc.bf, x.idx)', 'x.idx')}), "
            f"'buf': NULL::VARCHAR, 'bw': 0, 'bt': 0, 'bf': NULL::INTEGER, 'bl': x.idx}} "
            f"ELSE {{'done': acc.done, 'buf': {buf}, 'bw': acc.bw + x.n_words, 'bt': acc.bt + x.n_tok, "
            f"'bf': coalesce(acc.bf, x.idx), 'bl': x.idx}} END")
    init = (f"{{'done': []::{FRAG_T}[], 'buf': NULL::VARCHAR, 'bw': 0, 'bt': 0, "
            f"'bf': NULL::INTEGER, 'bl': NULL::INTEGER}}")
    acc = f"list_reduce({u}, {step}, {init})"
    alone = f"[{_frag('a.buf', 'a.bt', 'a.bf', 'a.bl')}]" if mode == "intended" else f"[]::{FRAG_T}[]"
    last = "a.done[len(a.done)]"
    merged = (f"list_append(a.done[1:len(a.done) - 1], "
              f"{_frag(last + '.text || ' + chr(39) + ' ' + chr(39) + ' || a.buf', last + '.n_tok + a.bt', last + '.fs', 'a.bl')})")
    return (f"(SELECT CASE WHEN a.buf IS NULL THEN a.done WHEN len(a.done) > 0 THEN {merged} "
            f"ELSE {alone} END FROM (SELECT {acc} AS a))")


def greedy_expr(frags: str, n: int = SEG_TOKENS) -> str:
    buf = "CASE WHEN acc.buf IS NULL THEN f.text ELSE acc.buf || ' ' || f.text END"
    full = f"acc.bt + f.n_tok >= {n}"
    step = (f"lambda acc, f: CASE WHEN {full} THEN "
            f"{{'done': list_append(acc.done, {_frag(buf, 'acc.bt + f.n_tok', 'coalesce(acc.bf, f.fs)', 'f.ls')}), "
            f"'buf': NULL::VARCHAR, 'bt': 0, 'bf': NULL::INTEGER, 'bl': f.ls}} "
            f"ELSE {{'done': acc.done, 'buf': {buf}, 'bt': acc.bt + f.n_tok, "
            f"'bf': coalesce(acc.bf, f.fs), 'bl': f.ls}} END")
    init = f"{{'done': []::{FRAG_T}[], 'buf': NULL::VARCHAR, 'bt': 0, 'bf': NULL::INTEGER, 'bl': NULL::INTEGER}}"
    acc = f"list_reduce({frags}, {step}, {init})"
    return (f"(SELECT CASE WHEN a.buf IS NULL THEN a.done "
            f"ELSE list_append(a.done, {_frag('a.buf', 'a.bt', 'a.bf', 'a.bl')}) END FROM (SELECT {acc} AS a))")


def reference_windows_expr(frags: str, n: int = SEG_TOKENS) -> str:
    short = f"list_filter({frags}, lambda f: f.n_tok < {n})"
    long = f"list_filter({frags}, lambda f: f.n_tok >= {n})"
    rest = _frag(f"array_to_string(list_transform({short}, lambda f: f.text), ' ')",
                 f"list_sum(list_transform({short}, lambda f: f.n_tok))",
                 f"list_min(list_transform({short}, lambda f: f.fs))",
                 f"list_max(list_transform({short}, lambda f: f.ls))")
    return f"CASE WHEN len({short}) > 0 THEN list_append({long}, {rest}) ELSE {long} END"


def _frag_rows(expr: str, with_range: bool = True) -> str:
    rng = ", (f).fs AS first_sent, (f).ls AS last_sent" if with_range else ""
    return f"""SELECT doc_id, (seg_no - 1)::INTEGER AS seg_no, (f).text AS text, (f).n_tok AS n_tok{rng}
FROM (SELECT doc_id, unnest(fr) AS f, generate_subscripts(fr, 1) AS seg_no FROM (SELECT doc_id, {expr} AS fr FROM units))"""


def ngram_terms(ch: str, n_min: int = 1, n_max: int = 3) -> str:
    parts = []
    for n in range(n_min, n_max + 1):
        cat = " || ".join(f"{ch}[i + {j}]" for j in range(n))
        parts.append(f"list_transform(range(1, len({ch}) - {n - 2}), lambda i: {cat})")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def char_counts(src: str = "labelled") -> str:
    return f"""chars AS (
  SELECT doc_id, label, string_split(regexp_replace(lower(text), {_q(tx.WS_RUN)}, ' ', 'g'), '') AS ch
  FROM {src} WHERE length(text) > 0),
grams AS (SELECT doc_id, label, unnest({ngram_terms('ch')}) AS term FROM chars),
cnt AS (SELECT doc_id, label, term, count(*) AS c FROM grams GROUP BY doc_id, label, term),
vocab_all AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
vocab AS (SELECT term, df FROM vocab_all WHERE df >= 3),
inv AS (SELECT cnt.*, vocab.df FROM cnt JOIN vocab USING (term)),
l1 AS (SELECT doc_id, label, term, c, c::DOUBLE / sum(c) OVER (PARTITION BY doc_id) AS value FROM inv)"""


CHAR_COUNTS = char_counts()

CHAR_SCORES = f"""{CHAR_COUNTS},
l2 AS (SELECT doc_id, label, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM l1),
priors AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM labelled GROUP BY label),
per_class AS (SELECT term, label, sum(value) AS o FROM l2 GROUP BY term, label),
agg AS (SELECT term, sum(o * o / p) AS s, sum(o) AS ft FROM per_class JOIN priors USING (label) GROUP BY term),
scores AS (SELECT 'char_ngram' AS fset, term, CASE WHEN ft <> 0 THEN s / ft - ft ELSE 'NaN'::DOUBLE END AS chi2 FROM agg)"""

TOKENS = f"""pieces AS (
  SELECT doc_id, unnest(pc) AS piece, generate_subscripts(pc, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all(text, {_q(tx.PIECE)}) AS pc FROM docs)),
pw AS (SELECT doc_id, p, piece, regexp_matches(piece, {_q('^' + tx.WS)}) AS is_ws,
  CASE WHEN regexp_matches(piece, {_q('^' + tx.WS)}) AND
            lag(piece) OVER (PARTITION BY doc_id ORDER BY p) IN ('.', '!', '?') THEN 1 ELSE 0 END AS brk
  FROM pieces),
ps AS (SELECT doc_id, p, piece, is_ws,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start,
  sum(brk) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent_no
  FROM pw),
tk AS (SELECT doc_id, sent_no::INTEGER AS sent_no, p, start, piece, {shape_tag('piece')} AS pos FROM ps WHERE NOT is_ws),
tokens AS (SELECT doc_id, sent_no,
  (row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY p) - 1)::INTEGER AS tok_no,
  start, (start + length(piece))::INTEGER AS "end", piece AS text, pos,
  coalesce(lag(pos) OVER (PARTITION BY doc_id, sent_no ORDER BY p), 'ROOT') || '>' || pos AS dep
  FROM tk)"""


def tag_counts(tag: str) -> str:
    return f"""WITH {DOCS}, {TOKENS},
t AS (SELECT doc_id, sent_no, tok_no, CASE WHEN coalesce({tag}, '') = '' THEN 'Unk' ELSE {tag} END AS tag FROM tokens),
n AS (SELECT doc_id, tag AS g1,
  tag || '-' || lead(tag, 1) OVER w AS g2,
  tag || '-' || lead(tag, 1) OVER w || '-' || lead(tag, 2) OVER w AS g3
  FROM t WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
g AS (SELECT doc_id, unnest([g1, g2, g3]) AS term FROM n),
cnt AS (SELECT doc_id, term, count(*) AS c FROM g WHERE term IS NOT NULL GROUP BY doc_id, term)"""


def tag_tfidf(tag: str) -> str:
    return f"""{tag_counts(tag)},
vocab AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
nd AS (SELECT count(*)::DOUBLE AS n FROM docs),
w AS (SELECT doc_id, term, (1 + ln(c)) * (ln((1 + nd.n) / (1 + df)) + 1) AS v FROM cnt JOIN vocab USING (term), nd)
SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM w"""


def ecdf_sql(values_cte: str, upto: int, prefix: str, empty: str = "0.0") -> str:
    nb = upto - 2
    return f"""WITH {DOCS}, {values_cte},
cnt AS (SELECT doc_id, least(v, {nb}) AS bin, count(*) AS n FROM vals WHERE v BETWEEN 1 AND {upto - 1} GROUP BY ALL),
grid AS (SELECT doc_id, unnest(range(1, {nb + 1})) AS bin FROM docs),
j AS (SELECT g.doc_id, g.bin, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN cnt c ON g.doc_id = c.doc_id AND g.bin = c.bin),
w AS (SELECT doc_id, bin, sum(n) OVER (PARTITION BY doc_id ORDER BY bin) AS cum,
             sum(n) OVER (PARTITION BY doc_id) AS total FROM j)
SELECT doc_id, '{prefix}_' || bin AS term,
       round(CASE WHEN total > 0 THEN cum::DOUBLE / total::DOUBLE ELSE {empty} END, 6) AS value FROM w"""


WORD_LENGTHS = f"""vals AS (SELECT doc_id, length(t) AS v FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM docs))"""
SENT_LENGTHS = f"""vals AS (SELECT doc_id, len({tokens('s')}) AS v FROM (SELECT doc_id, unnest({sentences('text')}) AS s FROM docs))"""

PUNCT_LIST = "[" + ", ".join(_q(c) for c in rules.PUNCTUATION) + "]"

SEGMENTS = f"""{units_cte()},
frags AS ({_frag_rows(greedy_expr(merge_expr('u')))}),
segs AS (
  SELECT doc_id, 'full' AS kind, 0 AS seg_no, len({tokens('text')})::INTEGER AS n_tok,
         NULL::INTEGER AS first_sent, NULL::INTEGER AS last_sent FROM docs
  UNION ALL SELECT doc_id, 'fragment' AS kind, seg_no, n_tok, first_sent, last_sent FROM frags)"""


SQL = {
    "corpus_clean": f"WITH {DOCS} SELECT doc_id, text, title, epoch, language, area, filename FROM docs",
    "corpus_filter_label": f"WITH {DOCS} SELECT doc_id, epoch FROM docs WHERE lower(epoch) <> 'es'",
    "label_encode": f"WITH {DOCS}, {LABELLED} SELECT doc_id, epoch, label FROM labelled",
    "class_balance": f"WITH {DOCS}, {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "sentences": f"""WITH {DOCS}
SELECT doc_id, (i - 1)::INTEGER AS sent_no, sentence, len({tokens('sentence')})::INTEGER AS n_tokens,
       ({n_words('sentence')})::INTEGER AS n_words
FROM (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i
      FROM (SELECT doc_id, {sentences('text')} AS ss FROM docs))""",
    "segments_endline": f"""WITH {DOCS}
SELECT doc_id, (i - 1)::INTEGER AS line_no, line
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
      FROM (SELECT doc_id, {endlines('text')} AS ls FROM docs))""",
    "sentence_merge": f"WITH {DOCS}, {units_cte()} {_frag_rows(merge_expr('u'))}",
    "sentence_merge_reference": f"WITH {DOCS}, {units_cte()} {_frag_rows(merge_expr('u', 'reference'))}",
    "windows_reference": f"WITH {DOCS}, {units_cte()} "
                         f"{_frag_rows(reference_windows_expr(merge_expr('u', 'reference')), with_range=False)}",
    "windows_greedy": f"WITH {DOCS}, {units_cte()} {_frag_rows(greedy_expr(merge_expr('u')))}",
    "windows_endline": f"""WITH {DOCS},
units AS (SELECT doc_id, list_transform({endlines('text')}, lambda s, i:
  {_frag('s', f"len({tokens('s')})", 'i - 1', 'i - 1')}) AS u FROM docs)
{_frag_rows(greedy_expr('u'))}""",
    "segments_full": f"""WITH {DOCS}, {LABELLED}, {SEGMENTS}
SELECT s.doc_id, kind, seg_no::INTEGER AS seg_no, label, n_tok, first_sent, last_sent
FROM segs s JOIN labelled l ON s.doc_id = l.doc_id""",
    "segment_index": f"""WITH {DOCS}, {SEGMENTS}
SELECT s.doc_id, kind, seg_no::INTEGER AS seg_no,
  d.filename || '_0_' || (row_number() OVER (PARTITION BY d.filename
     ORDER BY CASE WHEN kind = 'full' THEN 0 ELSE 1 END, s.doc_id, seg_no) - 1) AS "group"
FROM segs s JOIN docs d ON s.doc_id = d.doc_id""",
    "tokens_tagged": f"""WITH {DOCS}, {TOKENS}
SELECT doc_id, sent_no, tok_no, start, "end", text, pos, dep FROM tokens""",
    "segment_token_join": f"""WITH {DOCS}, {TOKENS}, {SEGMENTS},
j AS (SELECT s.doc_id, s.kind, s.seg_no, t.start, t."end" FROM segs s JOIN tokens t ON s.doc_id = t.doc_id
      AND (s.kind = 'full' OR t.sent_no BETWEEN s.first_sent AND s.last_sent))
SELECT doc_id, kind, seg_no::INTEGER AS seg_no, count(*) AS n_tokens, min(start) AS first_char,
       max("end") AS last_char FROM j GROUP BY doc_id, kind, seg_no""",
    "segment_locate_join": f"""WITH {DOCS}, {TOKENS}, {SEGMENTS},
fr AS (SELECT s.doc_id, s.seg_no, f.text AS ftext FROM segs s JOIN frags f ON s.doc_id = f.doc_id AND s.seg_no = f.seg_no
       WHERE s.kind = 'fragment'),
rg AS (SELECT fr.doc_id, fr.seg_no, (strpos(d.text, ({sentences('ftext')})[1]) - 1)::INTEGER AS seg_start,
              length(ftext) AS flen FROM fr JOIN docs d ON fr.doc_id = d.doc_id),
j AS (SELECT rg.doc_id, rg.seg_no, t.start, t."end" FROM rg JOIN tokens t ON rg.doc_id = t.doc_id
      AND t.start < rg.seg_start + rg.flen AND t."end" > rg.seg_start WHERE rg.seg_start >= 0)
SELECT doc_id, seg_no::INTEGER AS seg_no, count(*) AS n_tokens, min(start) AS first_char, max("end") AS last_char
FROM j GROUP BY doc_id, seg_no""",
    "word_length_ecdf": ecdf_sql(WORD_LENGTHS, 20, "word_length"),
    "sentence_length_ecdf": ecdf_sql(SENT_LENGTHS, 1000, "sentence_length"),
    "sentence_length_reference": ecdf_sql(WORD_LENGTHS, 1000, "word_length", "'NaN'::DOUBLE"),
    "char_ngram_vocab": f"WITH {DOCS}, {LABELLED}, {CHAR_COUNTS} SELECT term, df FROM vocab",
    "char_ngram_l1": f"WITH {DOCS}, {LABELLED}, {CHAR_COUNTS} SELECT doc_id, term, c, round(value, 6) AS value FROM l1",
    "char_ngram_totals": f"WITH {DOCS}, {LABELLED}, {CHAR_COUNTS} "
                         f"SELECT doc_id, sum(c)::BIGINT AS n_terms FROM inv GROUP BY doc_id",
    "punctuation_freq": f"""WITH {DOCS},
pc AS (SELECT doc_id, unnest(list_filter(string_split(lower(text), ''), lambda x: list_contains({PUNCT_LIST}, x))) AS term FROM docs),
cnt AS (SELECT doc_id, term, count(*) AS c FROM pc GROUP BY doc_id, term)
SELECT doc_id, term, c, round(c::DOUBLE / sum(c) OVER (PARTITION BY doc_id), 6) AS value FROM cnt""",
    "pos_ngram_tfidf": tag_tfidf("pos"),
    "dep_ngram_tfidf": tag_tfidf("dep"),
    "chi2_scores": f"WITH {DOCS}, {LABELLED}, {CHAR_SCORES} SELECT fset, term, round(chi2, 6) AS chi2 FROM scores",
    "select_k_best": f"""WITH {DOCS}, {LABELLED}, {CHAR_SCORES},
nf AS (SELECT count(*) AS n FROM scores),
kk AS (SELECT CASE WHEN n < 5000 THEN n ELSE round_even(n * 0.8, 0) END AS k FROM nf),
ranked AS (SELECT term, chi2, row_number() OVER (ORDER BY CASE WHEN isnan(chi2) THEN NULL ELSE chi2 END DESC NULLS LAST,
                  term DESC) AS r FROM scores)
SELECT term, round(chi2, 6) AS chi2 FROM ranked, kk WHERE r <= k""",
    "char_chi2_top20": f"""WITH {DOCS}, {LABELLED}, {CHAR_SCORES}
SELECT term, round(chi2, 6) AS chi2 FROM scores
ORDER BY CASE WHEN isnan(chi2) THEN NULL ELSE chi2 END DESC NULLS LAST, term DESC LIMIT 20""",
}


BDOCS = "bdocs AS (SELECT d.*, l.toxic::INTEGER AS label FROM docs d JOIN labels l ON d.doc_id = l.doc_id)"
SAMPLES = """st AS (SELECT count(*) AS n, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos FROM bdocs),
mp AS (SELECT n, pos, CASE WHEN pos = 0 OR pos / n > 0.5 THEN 0
                           ELSE trunc((pos - n * 0.5) / (0.5 - 1))::BIGINT END AS missing FROM st),
ex AS (SELECT n, pos, CASE WHEN pos = 0 THEN 0 ELSE floor(missing / pos)::BIGINT END AS extra, missing FROM mp),
ex2 AS (SELECT extra, missing - extra * pos AS remaining FROM ex),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('-', doc_id::VARCHAR, '0')), doc_id) - 1 AS r
       FROM bdocs WHERE label = 1),
samples AS (SELECT b.doc_id, b.label, (1 + CASE WHEN b.label = 1 THEN extra +
              CASE WHEN rk.r < remaining THEN 1 ELSE 0 END ELSE 0 END)::INTEGER AS copies
            FROM bdocs b LEFT JOIN rk ON b.doc_id = rk.doc_id, ex2)"""
CELLS = """bst AS (SELECT count(*) AS n, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos FROM bdocs),
ct AS (SELECT term, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS fp
       FROM l1 WHERE value > 0 GROUP BY term),
cells AS (SELECT term, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, (n - pos - fp)::BIGINT AS tn
          FROM ct, bst)"""




def _entropy_sql(*shares):
    return "(" + " + ".join(f"CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0.0 END" for p in shares) + ")"


IG = f"""shares AS (SELECT term, tp / n AS tp, fp / n AS fp, fn / n AS fn, tn / n AS tn
                   FROM (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM cells)),
ig AS (SELECT term, {_entropy_sql("tp + fn", "fp + tn")}
                    - ({_entropy_sql("tp", "fp", "fn", "tn")} - {_entropy_sql("tp + fp", "fn + tn")}) AS ig FROM shares)"""

FOLDED = """folded AS (SELECT doc_id, label, ((row_number() OVER (PARTITION BY label
    ORDER BY md5(concat_ws('-', doc_id::VARCHAR, '0')), doc_id) - 1) % 5)::INTEGER AS fold FROM labelled)"""

WL_VALUES = f"""wlv AS (SELECT doc_id, length(t) AS v FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM docs)),
wlc AS (SELECT doc_id, least(v, 18) AS bin, count(*) AS n FROM wlv WHERE v BETWEEN 1 AND 19 GROUP BY ALL),
wlg AS (SELECT doc_id, unnest(range(1, 19)) AS bin FROM docs),
wlj AS (SELECT g.doc_id, g.bin, coalesce(c.n, 0) AS n FROM wlg g LEFT JOIN wlc c ON g.doc_id = c.doc_id AND g.bin = c.bin),
wlw AS (SELECT doc_id, bin, sum(n) OVER (PARTITION BY doc_id ORDER BY bin) AS cum,
               sum(n) OVER (PARTITION BY doc_id) AS total FROM wlj),
wl AS (SELECT doc_id, 'word_length_' || bin AS term,
              CASE WHEN total > 0 THEN cum::DOUBLE / total::DOUBLE ELSE 0.0 END AS value FROM wlw)"""

PRED = """f AS (SELECT w.doc_id, w.term, w.value, fo.label, fo.fold FROM wl w JOIN folded fo ON w.doc_id = fo.doc_id),
n_cls AS (SELECT label, count(*) AS n_c FROM folded GROUP BY label),
n_fold AS (SELECT fold, label, count(*) AS n_ck FROM folded GROUP BY fold, label),
tot AS (SELECT label, term, sum(value) AS s_c FROM f GROUP BY label, term),
part AS (SELECT fold, label, term, sum(value) AS s_ck FROM f GROUP BY fold, label, term),
grid AS (SELECT t.label, t.term, t.s_c, n.n_c, unnest(range(0, 5)) AS fold FROM tot t JOIN n_cls n ON t.label = n.label),
cen AS (SELECT g.fold, g.label AS cls, g.term,
               (g.s_c - coalesce(p.s_ck, 0.0)) / (g.n_c - coalesce(nf.n_ck, 0)) AS mu
        FROM grid g LEFT JOIN part p ON g.fold = p.fold AND g.label = p.label AND g.term = p.term
        LEFT JOIN n_fold nf ON g.fold = nf.fold AND g.label = nf.label
        WHERE g.n_c - coalesce(nf.n_ck, 0) > 0),
dd AS (SELECT f.doc_id, f.label, f.fold, c.cls, sum((f.value - c.mu) * (f.value - c.mu)) AS dist
       FROM f JOIN cen c ON f.fold = c.fold AND f.term = c.term GROUP BY f.doc_id, f.label, f.fold, c.cls),
pred AS (SELECT doc_id, label, fold, first(cls ORDER BY dist, cls)::INTEGER AS prediction,
                exp(-min(dist)) / sum(exp(-dist)) AS proba FROM dd GROUP BY doc_id, label, fold),
cgrid AS (SELECT a.x AS label, b.x AS prediction FROM (SELECT unnest([0, 1, 2, 3]) AS x) a,
          (SELECT unnest([0, 1, 2, 3]) AS x) b),
cm AS (SELECT g.label::INTEGER AS label, g.prediction::INTEGER AS prediction, count(p.doc_id)::BIGINT AS n
       FROM cgrid g LEFT JOIN pred p ON g.label = p.label AND g.prediction = p.prediction
       GROUP BY g.label, g.prediction),
pc AS (SELECT t.label, t.n AS tp, r.support, c.predicted FROM (SELECT label, n FROM cm WHERE label = prediction) t
       JOIN (SELECT label, sum(n) AS support FROM cm GROUP BY label) r ON t.label = r.label
       JOIN (SELECT prediction, sum(n) AS predicted FROM cm GROUP BY prediction) c ON t.label = c.prediction),
prf AS (SELECT label, tp::BIGINT AS tp, (predicted - tp)::BIGINT AS fp, (support - tp)::BIGINT AS fn,
               CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 1.0 END AS precision,
               CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 1.0 END AS recall,
               CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 1.0 END AS f1,
               support::BIGINT AS support FROM pc)"""

_BIN = f"WITH {DOCS}, {BDOCS}, {char_counts('bdocs')}"
SQL.update({
    "dro_samples": f"WITH {DOCS}, {BDOCS}, {SAMPLES} SELECT doc_id, label, copies FROM samples",
    "dro_replicate": f"""WITH {DOCS}, {BDOCS}, {SAMPLES}
SELECT doc_id, unnest(range(0, copies))::INTEGER AS copy_no, label FROM samples""",
    "contingency": f"{_BIN}, {CELLS} SELECT term, tp, fp, fn, tn FROM cells",
    "info_gain": f"{_BIN}, {CELLS}, {IG} SELECT term, round(ig, 6) AS ig FROM ig",
    "tpr_fpr": f"""{_BIN}, {CELLS}
SELECT term, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END, 6) AS tpr,
       round(CASE WHEN tn + fp > 0 THEN fp::DOUBLE / (tn + fp) ELSE 0.0 END, 6) AS fpr FROM cells""",
    "dro_weights": f"""{_BIN}, {CELLS}, {IG},
ctot AS (SELECT term, sum(abs(value)) AS tot FROM l1 GROUP BY term)
SELECT l1.term, l1.doc_id, round((CASE WHEN tot > 0 THEN value / tot ELSE 0.0 END) * ig * 1e6, 6) AS weight_e6
FROM l1 JOIN ctot ON l1.term = ctot.term JOIN ig ON l1.term = ig.term""",
    "folds_stratified": f"WITH {DOCS}, {LABELLED}, {FOLDED} SELECT doc_id, label, fold FROM folded",
    "class_weights": f"""WITH {DOCS}, {LABELLED},
per AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM per""",
    "loo_stats": f"""WITH {DOCS}, {LABELLED}, {CHAR_COUNTS},
lost AS (SELECT doc_id, count(*) AS lost FROM cnt JOIN vocab_all USING (term) WHERE vocab_all.df = 3 GROUP BY doc_id),
nv AS (SELECT count(*) AS nv FROM vocab), nd AS (SELECT count(*) AS n FROM labelled),
pcl AS (SELECT label, count(*) AS nc FROM labelled GROUP BY label)
SELECT l.doc_id, (nd.n - 1)::BIGINT AS n_train, (pcl.nc - 1)::BIGINT AS class_train,
       (nv.nv - coalesce(lost.lost, 0))::BIGINT AS vocab_loo
FROM labelled l JOIN pcl ON l.label = pcl.label LEFT JOIN lost ON l.doc_id = lost.doc_id, nv, nd""",
    "centroid_predictions": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED}
SELECT doc_id, label, fold, prediction, round(proba, 6) AS proba FROM pred""",
    "accuracy_prf": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED}
SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM prf""",
    "accuracy_summary": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED}
SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM prf""",
    "confusion_matrix": f"WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED} SELECT label, prediction, n FROM cm",
    "posterior_median": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED}
SELECT fold, round(median(proba), 6) AS posterior_median FROM pred GROUP BY fold""",
})

TOKEN_SUMMARY = """SELECT doc_id, count(*) AS n_tokens, count(DISTINCT sent_no) AS n_sentences, max("end") AS last_char
FROM tokens {where} GROUP BY doc_id"""

BENCH_DOCS = f"""bench AS (
  SELECT item_id AS doc_id, {clean("coalesce(text, '')")} AS text, 0 AS label
  FROM benchmark WHERE {strip("coalesce(text, '')")} <> '')"""

SQL.update({
    "corpus_json_roundtrip": SQL["corpus_clean"],
    "results_append": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {WL_VALUES}, {PRED}
SELECT doc_id, label, 2::BIGINT AS n_runs, prediction,
       round(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS accuracy, round(proba, 6) AS proba FROM pred""",
    "annotate_incremental": f"WITH {DOCS}, {TOKENS} " + TOKEN_SUMMARY.format(where=""),
    "corpus_json_lines_ids": f"""WITH numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, * FROM documents),
{DOCS.replace("FROM documents", "FROM numbered").replace("SELECT doc_id,", "SELECT line::BIGINT AS doc_id,")}
SELECT doc_id, text, title, epoch, language, area, filename FROM docs""",
    "cache_reopened": f"WITH {DOCS}, {TOKENS} " + TOKEN_SUMMARY.format(
        where="WHERE doc_id IN (SELECT doc_id FROM docs WHERE epoch <> 'fr')"),
    "cache_delete": f"WITH {DOCS}, {TOKENS} " + TOKEN_SUMMARY.format(
        where="WHERE doc_id IN (SELECT doc_id FROM docs WHERE epoch <> 'fr')"),
    "transform_unseen": f"""WITH {DOCS}, {LABELLED}, {CHAR_COUNTS}, {BENCH_DOCS},
bchars AS (SELECT doc_id, string_split(regexp_replace(lower(text), {_q(tx.WS_RUN)}, ' ', 'g'), '') AS ch
           FROM bench WHERE length(text) > 0),
bgrams AS (SELECT doc_id, unnest({ngram_terms('ch')}) AS term FROM bchars),
bcnt AS (SELECT doc_id, term, count(*) AS c FROM bgrams GROUP BY doc_id, term),
binv AS (SELECT bcnt.* FROM bcnt JOIN vocab USING (term))
SELECT doc_id, term, c, round(c::DOUBLE / sum(c) OVER (PARTITION BY doc_id), 6) AS value FROM binv""",
    "feature_index": f"""WITH {DOCS}, {LABELLED}, {CHAR_SCORES},
nf AS (SELECT count(*) AS n FROM scores),
kk AS (SELECT CASE WHEN n < 5000 THEN n ELSE round_even(n * 0.8, 0) END AS k FROM nf),
ranked AS (SELECT term, row_number() OVER (ORDER BY CASE WHEN isnan(chi2) THEN NULL ELSE chi2 END DESC NULLS LAST,
                  term DESC) AS r FROM scores),
chosen AS (SELECT 'char_ngram' AS fset, term FROM ranked, kk WHERE r <= k
           UNION ALL SELECT 'word_length' AS fset, 'word_length_' || i AS term FROM range(1, 19) t(i)),
sizes AS (SELECT fset, count(*) AS n, CASE fset WHEN 'pos_ngram' THEN 0 WHEN 'word_length' THEN 1
            WHEN 'sentence_length' THEN 2 WHEN 'char_ngram' THEN 3 END AS set_no FROM chosen GROUP BY fset),
ranges AS (SELECT fset, n, coalesce(sum(n) OVER (ORDER BY set_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS start FROM sizes)
SELECT c.fset, c.term, (r.start + row_number() OVER (PARTITION BY c.fset ORDER BY c.term) - 1)::BIGINT AS col,
       r.start::BIGINT AS start, (r.start + r.n)::BIGINT AS "end"
FROM chosen c JOIN ranges r ON c.fset = r.fset""",
})

SQL["stream_char_ngrams"] = SQL["char_ngram_l1"]

REF_SEGMENTS = f"""{units_cte()},
rfr AS (SELECT doc_id, {reference_windows_expr(merge_expr('u', 'reference'))} AS fr FROM units),
wdoc AS (SELECT d.doc_id, 1 + coalesce(len(r.fr), 0) AS w FROM docs d LEFT JOIN rfr r ON d.doc_id = r.doc_id)"""

SQL.update({
    "weighted_vocab": f"""WITH {DOCS}, {LABELLED}, {CHAR_COUNTS}, {REF_SEGMENTS}
SELECT term, sum(w)::BIGINT AS df FROM cnt JOIN wdoc ON cnt.doc_id = wdoc.doc_id GROUP BY term HAVING sum(w) >= 3""",
    "segment_data": f"""WITH {DOCS}, {LABELLED}, {FOLDED}, {SEGMENTS}
SELECT s.doc_id, kind, seg_no::INTEGER AS seg_no, f.label,
       CASE WHEN f.fold <> 0 THEN 'dev' WHEN kind = 'full' THEN 'test' ELSE 'test_fragment' END AS split, n_tok
FROM segs s JOIN folded f ON s.doc_id = f.doc_id""",
    "reduce_unseen": f"""WITH {DOCS}, {LABELLED}, {CHAR_SCORES}, {BENCH_DOCS},
nf AS (SELECT count(*) AS n FROM scores),
kk AS (SELECT CASE WHEN n < 5000 THEN n ELSE round_even(n * 0.8, 0) END AS k FROM nf),
ranked AS (SELECT term, row_number() OVER (ORDER BY CASE WHEN isnan(chi2) THEN NULL ELSE chi2 END DESC NULLS LAST,
                  term DESC) AS r FROM scores),
chosen AS (SELECT term FROM ranked, kk WHERE r <= k),
bchars AS (SELECT doc_id, string_split(regexp_replace(lower(text), {_q(tx.WS_RUN)}, ' ', 'g'), '') AS ch
           FROM bench WHERE length(text) > 0),
bgrams AS (SELECT doc_id, unnest({ngram_terms('ch')}) AS term FROM bchars),
bcnt AS (SELECT doc_id, term, count(*) AS c FROM bgrams GROUP BY doc_id, term),
binv AS (SELECT bcnt.* FROM bcnt JOIN vocab USING (term)),
bl1 AS (SELECT doc_id, term, c::DOUBLE / sum(c) OVER (PARTITION BY doc_id) AS v FROM binv),
bl2 AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM bl1)
SELECT doc_id, term, round(v, 6) AS value FROM bl2 WHERE term IN (SELECT term FROM chosen)""",
})

SQL["segment_tokens_reference"] = f"""WITH {DOCS}, {TOKENS}, {REF_SEGMENTS}
SELECT t.doc_id, w::BIGINT AS w, count(*) AS n_tokens, (w * count(*))::BIGINT AS weighted_tokens
FROM tokens t JOIN wdoc ON t.doc_id = wdoc.doc_id GROUP BY t.doc_id, w"""

BFOLD = """bfold AS (SELECT doc_id, label, ((row_number() OVER (PARTITION BY label
    ORDER BY md5(concat_ws('-', doc_id::VARCHAR, '0')), doc_id) - 1) % 5)::INTEGER AS fold FROM bdocs),
dev AS (SELECT doc_id, label FROM bfold WHERE fold <> 0)"""

SQL["dro_tile_lengths"] = f"""WITH {DOCS}, {BDOCS}, {BFOLD}, {SAMPLES.replace("FROM bdocs", "FROM dev")}, {WL_VALUES},
train AS (SELECT w.doc_id, w.term, w.value, unnest(range(0, s.copies)) AS copy_no
          FROM wl w JOIN samples s ON w.doc_id = s.doc_id),
test AS (SELECT w.doc_id, w.term, w.value, unnest(range(0, 100)) AS copy_no
         FROM wl w JOIN bfold f ON w.doc_id = f.doc_id WHERE f.fold = 0)
SELECT doc_id, 'word_length' AS fset, term, round(value, 6) AS value, copy_no::INTEGER AS copy_no, 'train' AS split
FROM train
UNION ALL
SELECT doc_id, 'word_length' AS fset, term, round(value, 6) AS value, copy_no::INTEGER AS copy_no, 'test' AS split
FROM test"""


SQL["segment_features"] = f"""WITH {DOCS}, {LABELLED}, {TOKENS}, {SEGMENTS},
texts AS (
  SELECT doc_id::VARCHAR AS row_id, doc_id, 'full' AS kind, text, NULL::INTEGER AS first_sent, NULL::INTEGER AS last_sent FROM docs
  UNION ALL SELECT doc_id || '#' || seg_no, doc_id, 'fragment', text, first_sent, last_sent FROM frags),
seg_tokens AS (
  SELECT row_id, count(*) AS n_tokens FROM texts x JOIN tokens t
    ON x.doc_id = t.doc_id AND (x.kind = 'full' OR t.sent_no BETWEEN x.first_sent AND x.last_sent) GROUP BY row_id),
sc AS (SELECT row_id, string_split(regexp_replace(lower(text), {_q(tx.WS_RUN)}, ' ', 'g'), '') AS ch FROM texts),
sg AS (SELECT row_id, unnest({ngram_terms('ch')}) AS term FROM sc),
scnt AS (SELECT row_id, term, count(*) AS c FROM sg GROUP BY row_id, term),
svocab AS (SELECT term FROM scnt GROUP BY term HAVING count(*) >= 3),
sgrams AS (SELECT row_id, sum(c)::BIGINT AS n_grams FROM scnt JOIN svocab USING (term) GROUP BY row_id)
SELECT x.row_id, x.doc_id, x.kind, l.label, n_tokens, n_grams
FROM texts x JOIN labelled l ON x.doc_id = l.doc_id JOIN seg_tokens s ON s.row_id = x.row_id
LEFT JOIN sgrams g ON g.row_id = x.row_id"""

SQL["function_words"] = f"""WITH {DOCS},
wt AS (SELECT doc_id, unnest(list_filter({tokens('lower(text)')}, lambda t: regexp_matches(t, {_q(tx.LETTER)}))) AS term FROM docs),
top AS (SELECT term FROM wt GROUP BY term ORDER BY count(*) DESC, term LIMIT 50)
SELECT doc_id, term, count(*) AS c FROM wt WHERE term IN (SELECT term FROM top) GROUP BY doc_id, term"""


_DRAWN = f"""{_BIN}, {CELLS}, {IG}, {SAMPLES},
wx AS (SELECT l1.doc_id, l1.term, value * ig AS w FROM l1 JOIN ig USING (term) WHERE value * ig > 0),
totals AS (SELECT doc_id, sum(c) AS n_words FROM inv GROUP BY doc_id)"""

SQL["dro_latent_expected"] = f"""{_DRAWN},
wz AS (SELECT doc_id, sum(w) AS z FROM wx GROUP BY doc_id),
per AS (SELECT s.doc_id, s.copies * t.n_words / z AS m FROM samples s JOIN totals t USING (doc_id) JOIN wz USING (doc_id)),
mass AS (SELECT term, sum(w * m) AS mass FROM wx JOIN per USING (doc_id) GROUP BY term),
ctot AS (SELECT term, sum(value) AS tot FROM l1 GROUP BY term)
SELECT l1.doc_id AS latent_doc, round(sum(mass * value / tot), 3) AS expected
FROM l1 JOIN mass USING (term) JOIN ctot USING (term) GROUP BY l1.doc_id"""

SQL["dro_draw_totals"] = f"""{_DRAWN}
SELECT s.doc_id, unnest(range(0, s.copies))::INTEGER AS copy_no, t.n_words::BIGINT AS n_drawn
FROM samples s JOIN totals t USING (doc_id) WHERE s.doc_id IN (SELECT doc_id FROM wx)"""

SQL["dro_transform"] = f"""WITH {DOCS}, {BDOCS}, {BFOLD},
bdev AS (SELECT b.* FROM bdocs b JOIN dev ON b.doc_id = dev.doc_id),
btest AS (SELECT b.* FROM bdocs b JOIN bfold f ON b.doc_id = f.doc_id WHERE f.fold = 0),
{char_counts('bdev')}, {CELLS.replace("FROM bdocs", "FROM dev")}, {IG},
tchars AS (SELECT doc_id, string_split(regexp_replace(lower(text), {_q(tx.WS_RUN)}, ' ', 'g'), '') AS ch
           FROM btest WHERE length(text) > 0),
tgrams AS (SELECT DISTINCT doc_id, unnest({ngram_terms('ch')}) AS term FROM tchars),
tobs AS (SELECT doc_id, count(*) AS n_observed, max(ig) AS most FROM tgrams JOIN ig USING (term) GROUP BY doc_id)
SELECT doc_id, unnest(range(0, 2))::INTEGER AS copy_no, n_observed,
       CASE WHEN most > 0 THEN 1.0 END::DOUBLE AS latent_norm FROM tobs"""

SQL["punctuation_totals"] = f"""WITH {DOCS},
pc AS (SELECT doc_id, unnest(list_filter(string_split(lower(text), ''), lambda x: list_contains({PUNCT_LIST}, x))) AS term FROM docs)
SELECT doc_id, count(*) AS n_terms FROM pc GROUP BY doc_id"""

SQL["pos_ngram_totals"] = f"{tag_counts('pos')} SELECT doc_id, sum(c)::BIGINT AS n_terms FROM cnt GROUP BY doc_id"

SQL["drop_null"] = f"""WITH {DOCS},
lines AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, line AS text
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                FROM (SELECT doc_id, {endlines('text')} AS ls FROM docs)))
SELECT doc_id, line_no, text FROM lines WHERE {n_words('text')} > 0"""
