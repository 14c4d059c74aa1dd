"""Registered queries of the tokenizer, sequence and generation operators.

The BPE and sequence queries run the real tokenizer with the 50,000 merges of a public tokenizer file; their SQL
twins read the same file and repeat, for every distinct word, the merge of lowest rank until none fits.  Only the
vocabulary (``tok_vocab``) is learned from the corpus, by its pair counts, on both sides.  So ids, layout,
cutting, windows, folds, buffering, padding and features are all checked exactly against DuckDB at the
reference's lengths.  The generation contexts take ids from a SQL-reproducible stand-in encoder (``word_ids``: each
word hashed into 1..50000).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, text as TX
from newsloom.operators import evaluate as E, models as MD, sequences as Q, tokenize as TK
from newsloom.plans import common as K, sqltext as S
from newsloom.operators.common import with_computed
from newsloom.session import cut_lineage
from newsloom.sources.readers import with_row_index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


N_MERGES = 50                              # of the vocabulary learned from the corpus
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCAB = 50000
SP = TK.special_ids(len(TK.file_merges(TOKENIZER)))
L = fixed.SEQUENCE_LENGTH                  # stored as L + 1
WORDS = MD.WORD_PATTERN


def word_ids(col: str) -> F.Column:
    toks = F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(WORDS), F.lit(0))
    return F.transform(toks, lambda w: (F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint"),
                                               F.lit(WORD_VOCAB)) + 1).cast("int"))


def word_ids_sql(col: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({col}, ''), {S.q(WORDS)}), "
            f"lambda w: (1 + (('0x' || substr(md5(w), 1, 6))::BIGINT % {WORD_VOCAB}))::INTEGER)")


def _merges(spark: SparkSession) -> DataFrame:
    return TK.read_merges_file(spark, TOKENIZER)


# ------------------------------------------------------------------------------ tokenizer
@register("tok_encode")
def tok_encode(spark: SparkSession, sf: str) -> DataFrame:
    """T-2 + T-3 + T-5 (+ J6): every document encoded with the merge table of the tokenizer file."""
    docs = K.table(spark, sf, "documents").select("doc_id", "text")
    enc = TK.encode(docs, "text", _merges(spark))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@register("tok_roundtrip", "SELECT doc_id, true AS same FROM documents")
def tok_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """T-6: decode(encode(text)) == text for every document (expected: all true)."""
    m = _merges(spark)
    docs = K.table(spark, sf, "documents").select("doc_id", "text")
    back = TK.decode(TK.encode(docs, "text", m), "ids", m, out="back")
    return back.select("doc_id", (F.col("back") == F.col("text")).alias("same"))


@register("tok_pair_counts")
def tok_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    """T-7: adjacent byte-character pair counts over all pre-tokens of the corpus."""
    docs = K.table(spark, sf, "documents")
    words = docs.select(F.explode(TK.pretokens("text")).alias("w")).select(TK.byte_encode_sql_free("w").alias("word"))
    return TK.pair_counts(words)


@register("tok_vocab")
def tok_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """T-1 + T-4 + T-7 + P25: vocabulary ids for bytes, merges (learned from pair counts) and special tokens."""
    return TK.build_vocab(spark, TK.top_pair_merges(spark, K.table(spark, sf, "documents"), "text", N_MERGES))


# ------------------------------------------------------------------------------ dates
@register("date_spelled", f"""
SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS publish_date,
  {S.q('')} || ([{', '.join(S.q(m) for m in fixed.MONTHS)}])[month(o_orderdate)] || ' ' || strftime(o_orderdate, '%d') || ', '
  || strftime(o_orderdate, '%Y') AS date_txt
FROM orders""")
def date_spelled(spark: SparkSession, sf: str) -> DataFrame:
    """P5 + P16: timestamps -> MM-dd-yyyy -> 'Month dd, yyyy'."""
    o = K.table(spark, sf, "orders").select("o_orderkey", TX.mm_dd_yyyy("o_orderdate").alias("publish_date"))
    return o.withColumn("date_txt", TX.spelled_date("publish_date"))


# ------------------------------------------------------------------------------ sequences
def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in articles: domain from the source, title = first line, text = the rest, summary = second line, date and
    authors by a rule on doc_id (no author, one of 5 letters, two)."""
    title = F.substring_index("text", "\n", 1)
    body = F.substring(F.col("text"), F.length(title) + 2, 1 << 30)
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    return K.table(spark, sf, "documents").select(
        "doc_id", "source", F.concat("source", F.lit(".example.com")).alias("domain"), title.alias("title"), body.alias("text"),
        F.substring_index(body, "\n", 1).alias("summary"),
        F.date_format(F.date_add(F.lit("2016-12-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(900)).cast("int")), "MM-dd-yyyy").alias("publish_date"),
        F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("Staff")))
        .otherwise(F.array(F.concat(F.lit("Reporter "), "source"), F.lit("Ann O'Neil"))).alias("authors"))


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Per-field id pieces of every document (P16-P18, T-5)."""
    p = Q.article_pieces(articles(spark, sf), _merges(spark), SP)
    return p.select("doc_id", "source", *[f"p_{f}" for f in Q.FIELDS])


def _wrap_sql(x: str, field: str) -> str:
    return f"list_concat([{SP['begin_' + field]}], {x}, [{SP['end_' + field]}])"


# ------------------------------------------------------------------ tokenizer in SQL (DuckDB)
# Java's (?U)\s is the Unicode White_Space set; RE2 has no look-ahead, so the whitespace branch
# "\s+(?!\S)" is emulated: a run of two or more followed by a token gives up its last character,
# which joins the next token when it is a space and stands alone otherwise.
_WSJ = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_P2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WSJ[1:-1] + r"\p{L}\p{N}]+|" + _WSJ + "+"


def _isws(x: str) -> str:
    return f"regexp_full_match({x}, {S.q(_WSJ + '+')})"


def pretokens_sql(src: str, key: str) -> str:
    """(key, pre list) with the pre-tokens of ``text``."""
    return f"""(SELECT {key}, flatten(list_transform(range(1, len(toks) + 1), lambda i:
       CASE WHEN {_isws('toks[i]')} AND i < len(toks) AND length(toks[i]) >= 2 THEN
              (CASE WHEN right(toks[i], 1) = ' ' THEN [left(toks[i], length(toks[i]) - 1)]
                    ELSE [left(toks[i], length(toks[i]) - 1), right(toks[i], 1)] END)
            WHEN i > 1 AND {_isws('toks[i-1]')} AND length(toks[i-1]) >= 2 AND right(toks[i-1], 1) = ' '
                 AND NOT {_isws('toks[i]')} THEN [' ' || toks[i]]
            ELSE [toks[i]] END)) AS pre
      FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), {S.q(_P2)}) AS toks FROM {src}))"""


def byte_encode_sql(w: str) -> str:
    """UTF-8 bytes of ``w`` (from code points) mapped through the byte table."""
    table = "[" + ", ".join(S.q(c) for c in fixed.byte_table()) + "]"
    bytes_ = (f"flatten(list_transform(list_transform(string_split({w}, ''), lambda c: unicode(c)), lambda cp: "
              f"CASE WHEN cp < 128 THEN [cp] WHEN cp < 2048 THEN [192 + cp // 64, 128 + cp % 64] "
              f"WHEN cp < 65536 THEN [224 + cp // 4096, 128 + (cp // 64) % 64, 128 + cp % 64] "
              f"ELSE [240 + cp // 262144, 128 + (cp // 4096) % 64, 128 + (cp // 64) % 64, 128 + cp % 64] END))")
    return f"array_to_string(list_transform({bytes_}, lambda b: {table}[b + 1]), '')"


MERGES_SQL = f"""(SELECT (i - 1)::INTEGER AS rank, m[i][1] AS "left", m[i][2] AS "right" FROM (
  SELECT m, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]') AS m FROM read_text({S.q(TOKENIZER)}))))"""


def _byte_rows() -> str:
    table = fixed.byte_table()
    return ", ".join(f"({S.q(table[b])}, {i + 1})" for i, b in enumerate(TK.byte_order()))


def encode_sql(src: str, key: str) -> str:
    """(key, ids): ``text`` of ``src`` as token ids.  A word's symbols stand between chr(1) and chr(2); each step replaces
    all places of the pair of lowest rank in every word that has one."""
    pair = 'chr(1) || l || chr(2) || chr(1) || r || chr(2)'
    return f"""(WITH RECURSIVE src AS (SELECT * FROM {src}),
      m AS MATERIALIZED (SELECT * FROM {MERGES_SQL}),
      vocab AS (SELECT b_tok AS token, b_id::INTEGER AS id FROM (VALUES {_byte_rows()}) bv(b_tok, b_id)
                UNION ALL SELECT "left" || "right", rank + 257 FROM m),
      occ AS MATERIALIZED (SELECT {key}, unnest(pre) AS w, generate_subscripts(pre, 1) AS pos FROM {pretokens_sql('src', key)}),
      bpe(step, w, s) AS (
        SELECT 0, w, array_to_string(list_transform(string_split({byte_encode_sql('w')}, ''), lambda c: chr(1) || c || chr(2)), '')
        FROM (SELECT DISTINCT w FROM occ)
        UNION ALL
        SELECT step + 1, w, replace(s, {pair}, chr(1) || l || r || chr(2)) FROM (
          SELECT step, w, s, arg_min("left", rank) AS l, arg_min("right", rank) AS r
          FROM (SELECT step, w, s, unnest(list_zip(y[:-2], y[2:])) AS p
                FROM (SELECT step, w, s, string_split(s[2:-2], chr(2) || chr(1)) AS y FROM bpe)) x
          JOIN m ON m."left" = p[1] AND m."right" = p[2] GROUP BY step, w, s)),
      merged AS (SELECT w, string_split(arg_max(s, step)[2:-2], chr(2) || chr(1)) AS y FROM bpe GROUP BY w),
      word_ids AS (SELECT w, list(id ORDER BY k) AS ids FROM (SELECT w, unnest(y) AS token, generate_subscripts(y, 1) AS k FROM merged)
                   JOIN vocab USING (token) GROUP BY w),
      doc_ids AS (SELECT {key}, flatten(list(ids ORDER BY pos)) AS ids FROM occ JOIN word_ids USING (w) GROUP BY {key})
    SELECT {key}, coalesce(ids, []::INTEGER[]) AS ids FROM (SELECT DISTINCT {key} FROM src) LEFT JOIN doc_ids USING ({key}))"""


ARTICLES_SQL = f"""(SELECT *, split_part(text, chr(10), 1) AS summary,
    strftime(DATE '2016-12-01' + CAST(doc_id % 900 AS INTEGER), '%m-%d-%Y') AS publish_date,
    CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Staff'] ELSE ['Reporter ' || source, 'Ann O''Neil'] END AS authors
  FROM (SELECT doc_id, source, source || '.example.com' AS domain, split_part(text, chr(10), 1) AS title,
               substring(text, length(split_part(text, chr(10), 1)) + 2) AS text FROM documents))"""
_FIELDS_SQL = f"""(SELECT doc_id, f.field, f.text FROM (SELECT doc_id, unnest([
    {{'field': 'domain', 'text': domain}}, {{'field': 'title', 'text': title}}, {{'field': 'article', 'text': text}},
    {{'field': 'summary', 'text': CASE WHEN length(summary) > {fixed.MIN_PIECE_SUMMARY_LENGTH} THEN summary END}},
    {{'field': 'date', 'text': ([{', '.join(S.q(m) for m in fixed.MONTHS)}])[CAST(publish_date[1:2] AS INTEGER)] || ' ' || publish_date[4:5] || ', ' || publish_date[7:]}},
    {{'field': 'authors', 'text': CASE WHEN length(array_to_string(authors, ', ')) > {fixed.MIN_AUTHORS_LENGTH} THEN array_to_string(authors, ', ') END}}
  ]) AS f FROM {ARTICLES_SQL}) WHERE f.text IS NOT NULL)"""
PIECES_SQL = f"""(SELECT doc_id, any_value(source) AS source, {', '.join(f"max(CASE WHEN field = '{f}' THEN {_wrap_sql('ids', f)} END) AS p_{f}" for f in Q.FIELDS)}
  FROM {encode_sql(_FIELDS_SQL, 'doc_id, field')} JOIN documents USING (doc_id) GROUP BY doc_id)"""


def _u(purpose: str, key: str = "doc_id", seed: int = 0) -> str:
    return S.uniform(seed, purpose, key)


def _layout_sql(size: int, p_uncond=fixed.UNCONDITIONAL_PROB, p_drop=fixed.METADATA_DROPOUT_PROB,
                p_cut=fixed.CUT_PROB, pad: int = 0) -> str:
    def p(f):
        return f"coalesce(p_{f}, []::INTEGER[])"
    empty = "[]::INTEGER[]"
    m1_b = "list_concat(" + ", ".join(f"CASE WHEN {_u('keep_' + f)} > {p_drop} THEN {p(f)} ELSE {empty} END"
                                      for f in fixed.CANONICAL_METADATA + ["summary"]) + ")"
    m2_a = "list_concat(" + ", ".join(p(f) for f in Q.FIELDS) + ")"

    def dropped(f):
        return "false" if f in ("article", "title") else f"({_u('drop_' + f)} < {p_drop})"

    def coin(f):
        return f"({_u('coin_' + f)} < 0.5)"
    m3_a = "list_concat(" + ", ".join(
        f"CASE WHEN NOT {dropped(f)} AND {coin(f)} AND {'true' if f != 'summary' else 'false'} THEN {p(f)} ELSE {empty} END"
        for f in Q.FIELDS) + ")"
    m3_b = "list_concat(" + ", ".join(
        f"CASE WHEN NOT {dropped(f)} AND NOT {coin(f)} THEN {p(f)} ELSE {empty} END" for f in Q.FIELDS) + ")"
    sw = _u("switch")
    a = f"(CASE WHEN {sw} < {p_uncond} THEN {p('article')} WHEN {sw} < 0.5 THEN {m2_a} ELSE {m3_a} END)"
    b = f"(CASE WHEN {sw} < {p_uncond} THEN {m1_b} WHEN {sw} < 0.5 THEN {empty} ELSE {m3_b} END)"
    art_a = f"(CASE WHEN {sw} < 0.5 THEN true ELSE {coin('article')} END)"
    cut = (f"(CASE WHEN len(a) >= {size} THEN a WHEN len(b) >= {size} THEN a WHEN len(a) + len(b) <= {size} "
           f"THEN list_concat(a, b) ELSE list_concat(a[1:greatest({size} - len(b) - 1, 0)], [{pad}], b) END)")
    return f"""(SELECT *, CASE WHEN len(a) + len(b) <= {size} THEN list_concat(a, b)
        WHEN art_a AND len(b) > 0 AND {_u('cut')} < {p_cut} THEN {cut} ELSE list_concat(a, b) END AS input_ids
      FROM (SELECT *, {a} AS a, {b} AS b, {art_a} AS art_a FROM {PIECES_SQL}))"""


LAYOUT_SQL = _layout_sql(L + 1)


def _laid(spark: SparkSession, sf: str) -> DataFrame:
    return Q.layout_fields(pieces(spark, sf), "doc_id", size=L + 1)


@register("seq_pieces", f"""
SELECT doc_id, {', '.join(f"array_to_string(p_{f}, ' ') AS {f}" for f in Q.FIELDS)} FROM {PIECES_SQL}""")
def seq_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """P16 + P17 + P18 + T-5: the id pieces of every article's fields, null where a field is absent."""
    return pieces(spark, sf).select("doc_id", *[F.array_join(f"p_{f}", " ").alias(f) for f in Q.FIELDS])


@register("seq_layout", f"""
SELECT doc_id, len(input_ids) AS n_ids, array_to_string(input_ids, ' ') AS ids FROM {LAYOUT_SQL}""")
def seq_layout(spark: SparkSession, sf: str) -> DataFrame:
    """P18 + Q1 + Q2: random field layout (three modes) with the cut that makes room for part b."""
    lay = _laid(spark, sf)
    return lay.select("doc_id", F.size("input_ids").alias("n_ids"), F.array_join("input_ids", " ").alias("ids"))


def _floyd_sql(n: str, size: int, key: str, seed: int) -> str:
    spans = f"({n} - {size} + 1)"
    k = f"CAST(floor(0.5 + {n} / {size}) AS INTEGER)"
    u = (f"(('0x' || substr(md5('{seed}' || '|' || 'win' || '|' || CAST({key} AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 8))::BIGINT"
         f" / 4294967296.0)")
    t = f"CAST(floor({u} * (j + 1)) AS INTEGER)"
    return (f"list_reduce(range({spans} - {k}, {spans}), lambda acc, j: CASE WHEN list_contains(acc, {t}) "
            f"THEN list_append(acc, j::INTEGER) ELSE list_append(acc, {t}) END, []::INTEGER[])")


FOLDS = 4
SEED = 1337


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators import merge as M
    lay = _laid(spark, sf)
    lay = with_row_index(lay, ["doc_id"], "line")
    lay = M.assign_split(lay, "doc_id")
    # the laid-out corpus feeds two branches and a quantile pass: materialise it once
    return cut_lineage(Q.assign_folds(lay, "line", FOLDS))


FOLDED_SQL = f"""(SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {FOLDS} AS INTEGER) AS fold,
    CAST((row_number() OVER (ORDER BY doc_id) - 1) // {FOLDS} AS BIGINT) AS inst_index,
    CASE WHEN {S.uniform(0, 'split', 'doc_id')} < {fixed.TRAIN_PORTION} THEN 'train' ELSE 'val' END AS split
  FROM {LAYOUT_SQL})"""


@register("seq_folds", f"SELECT doc_id, fold, inst_index, split FROM {FOLDED_SQL}")
def seq_folds(spark: SparkSession, sf: str) -> DataFrame:
    """W9 + P19 + P14: line number, fold = line mod 4, inst_index = line div 4, split."""
    return _folded(spark, sf).select("doc_id", "fold", "inst_index", "split")


@register("seq_windows", f"""
SELECT doc_id, sub_index, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids FROM (
  SELECT doc_id, (gs - 1) AS sub_index,
         CASE WHEN len(input_ids) <= {L + 1} THEN list_concat(input_ids, list_transform(range({L + 1} - len(input_ids)), lambda x: 0))
              ELSE input_ids[starts[gs] + 1 : starts[gs] + {L + 1}] END AS ids
  FROM (SELECT *, generate_subscripts(starts, 1) AS gs FROM (
        SELECT *, CASE WHEN len(input_ids) <= {L + 1} THEN [0] ELSE {_floyd_sql('len(input_ids)', L + 1, 'doc_id', SEED)} END AS starts
        FROM {LAYOUT_SQL})))""")
def seq_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 + Q7: every laid-out document as fixed-length spans (short ones padded)."""
    w = Q.window_sequences(_laid(spark, sf), "doc_id", size=L + 1, seed=SEED)
    return w.select("doc_id", "sub_index", F.size("input_ids").alias("n_ids"), F.array_join("input_ids", " ").alias("ids"))


@register("seq_build", f"""
WITH f AS {FOLDED_SQL},
lw AS (SELECT fold, split, inst_index, (gs - 1) AS sub_index,
         CASE WHEN len(input_ids) <= {L + 1} THEN list_concat(input_ids, list_transform(range({L + 1} - len(input_ids)), lambda x: 0))
              ELSE input_ids[starts[gs] + 1 : starts[gs] + {L + 1}] END AS ids
       FROM (SELECT *, generate_subscripts(starts, 1) AS gs FROM (
             SELECT *, CASE WHEN len(input_ids) <= {L + 1} THEN [0] ELSE {_floyd_sql('len(input_ids)', L + 1, "(fold || '|' || inst_index)", SEED)} END AS starts
             FROM f WHERE len(input_ids) > 0 AND (split = 'val' OR len(input_ids) >= {L + 1})))),
sh AS (SELECT fold, split, inst_index, 0 AS sub_index,
         list_concat(input_ids, list_transform(range({L + 1} - len(input_ids)), lambda x: 0)) AS ids
       FROM f WHERE len(input_ids) > 0 AND split <> 'val' AND len(input_ids) < {L + 1})
SELECT fold, split, inst_index, sub_index, len(ids) AS n_ids, array_to_string(ids, ' ') AS ids FROM lw
UNION ALL SELECT fold, split, inst_index, sub_index, len(ids), array_to_string(ids, ' ') FROM sh""")
def seq_build(spark: SparkSession, sf: str) -> DataFrame:
    """Q4 + Q3 + Q5 + Q7 + F19: val or long articles through the window, short ones buffered and
    padded; all of length L + 1."""
    seqs = Q.build_sequences(_folded(spark, sf), size=L + 1, seed=SEED)
    return seqs.select("fold", "split", "inst_index", "sub_index", F.size("input_ids").alias("n_ids"),
                       F.array_join("input_ids", " ").alias("ids"))


@register("seq_buffer", f"""
SELECT fold, inst_index, CAST(floor((row_number() OVER (PARTITION BY fold ORDER BY inst_index) - 1) / 100) AS BIGINT) AS buffer_batch,
       {S.uniform(SEED, 'buffer', 'fold', 'inst_index')} AS buffer_order
FROM {FOLDED_SQL} WHERE len(input_ids) > 0 AND split <> 'val' AND len(input_ids) < {L + 1}""")
def seq_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: short articles per fold in batches of 100, shuffled inside each batch."""
    f = _folded(spark, sf)
    short = f.where((F.size("input_ids") > 0) & (F.col("split") != "val") & (F.size("input_ids") < L + 1))
    return Q.buffer_batches(short, seed=SEED).select("fold", "inst_index", "buffer_batch", "buffer_order")


def _pack_sql(size: int, reset: int) -> str:
    item = "STRUCT(i BIGINT, s VARCHAR, ids INTEGER[])"
    grown = f"list_concat(acc.cur, [0, {reset}], x.ids)"
    step = (f"CASE WHEN NOT acc.open THEN struct_pack(done := acc.done, open := true, ci := x.i, cs := x.s, cur := x.ids) "
            f"WHEN len({grown}) >= {size} THEN struct_pack(done := list_append(acc.done, "
            f"struct_pack(i := acc.ci, s := acc.cs, ids := {grown}[1:{size}])), open := false, ci := acc.ci, cs := acc.cs, cur := acc.cur) "
            f"ELSE struct_pack(done := acc.done, open := true, ci := acc.ci, cs := acc.cs, cur := {grown}) END")
    init = (f"struct_pack(done := []::{item}[], open := false, ci := 0::BIGINT, cs := '', cur := []::INTEGER[])")
    return f"""(SELECT fold, r.i AS inst_index, r.s AS split, r.ids AS ids FROM (
      SELECT fold, unnest(CASE WHEN st.open THEN list_append(st.done, struct_pack(i := st.ci, s := st.cs, ids := st.cur))
                               ELSE st.done END) AS r
      FROM (SELECT fold, list_reduce(items, lambda acc, x: {step}, {init}) AS st FROM (
            SELECT fold, buffer_batch, list(struct_pack(i := inst_index, s := split, ids := input_ids)::{item} ORDER BY buffer_order) AS items
            FROM short GROUP BY fold, buffer_batch))))"""


@register("seq_packed", f"""
WITH f AS {FOLDED_SQL},
short AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY fold ORDER BY inst_index) - 1) / 100) AS BIGINT) AS buffer_batch,
                 {S.uniform(SEED, 'buffer', 'fold', 'inst_index')} AS buffer_order
          FROM f WHERE len(input_ids) > 0 AND split <> 'val' AND len(input_ids) < {L + 1}),
p AS {_pack_sql(L + 1, SP['reset'])}
SELECT fold, split, inst_index, 0 AS sub_index,
       array_to_string(list_concat(ids, list_transform(range({L + 1} - len(ids)), lambda x: 0)), ' ') AS ids FROM p""")
def seq_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Q6 + Q7: short articles packed per buffer batch in shuffled order (pad + reset between
    articles, overflow of the last one dropped), padded to L + 1."""
    f = _folded(spark, sf)
    short = f.where((F.size("input_ids") > 0) & (F.col("split") != "val") & (F.size("input_ids") < L + 1))
    packed = Q.pack_buffer(Q.buffer_batches(short, seed=SEED), L + 1, pad=0, reset=SP["reset"])
    return packed.select("fold", "split", "inst_index", F.lit(0).alias("sub_index"),
                         F.array_join("input_ids", " ").alias("ids"))


CLF_L = fixed.SEQUENCE_LENGTH


@register("clf_features", f"""
WITH p AS {PIECES_SQL}, l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'human' ELSE 'machine' END AS label FROM labels),
x AS (SELECT p.doc_id, l.label, list_concat(p_domain, p_date, coalesce(p_authors, []::INTEGER[]), p_title, p_article, [{SP['begin_summary']}]) AS toks
      FROM p JOIN l ON p.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN label = 'machine' THEN 0 ELSE 1 END AS label_ids, 1 AS is_real_example,
  array_to_string(CASE WHEN len(toks) > {CLF_L} THEN toks[len(toks) - {CLF_L} + 1:]
       ELSE list_concat(toks, list_transform(range({CLF_L} - len(toks)), lambda x: 0)) END, ' ') AS input_ids
FROM x""")
def clf_features(spark: SparkSession, sf: str) -> DataFrame:
    """Q10 + Q11: classification ids (domain, date, authors, title, article pieces) + class token, tail of 1,024 kept."""
    lab = K.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "human")
                                              .otherwise("machine").alias("label"))
    p = pieces(spark, sf).join(lab, "doc_id")
    ids = Q.classification_ids(p, ["p_domain", "p_date", "p_authors", "p_title", "p_article"])
    feats = Q.classification_features(ids, CLF_L, SP["begin_summary"])
    return feats.select("doc_id", "label_ids", "is_real_example", F.array_join("input_ids", " ").alias("input_ids"))


@register("seq_batches", """
SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch FROM documents
QUALIFY batch < (SELECT count(*) FROM documents) // 64""")
def seq_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: batches of 64 in order, remainder dropped."""
    return Q.batches(K.table(spark, sf, "documents").select("doc_id"), "doc_id", 64)


@register("seq_epochs", f"""
SELECT doc_id, epoch, {S.uniform(0, 'epoch', 'epoch', 'doc_id')} AS shuffle_key
FROM documents, (SELECT range AS epoch FROM range(2))""")
def seq_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Q13: two passes over the corpus, each in its own shuffled order."""
    return Q.epoch_order(K.table(spark, sf, "documents").select("doc_id"), "doc_id", 2).select(
        "doc_id", "epoch", "shuffle_key")


@register("seq_positions", f"""
SELECT doc_id,
  coalesce(list_position(input_ids, {SP['begin_article']}) - 1, -1) AS first_article,
  CASE WHEN list_position(list_reverse(input_ids), {SP['end_article']}) IS NULL THEN -1
       ELSE len(input_ids) - list_position(list_reverse(input_ids), {SP['end_article']}) END AS last_end_article,
  coalesce(list_position(input_ids, {SP['begin_article']}), 0) AS start_ind,
  coalesce(list_position(input_ids, {SP['end_article']}) - 1, len(input_ids)) AS end_ind
FROM {LAYOUT_SQL}""")
def seq_positions(spark: SparkSession, sf: str) -> DataFrame:
    """W6 + W7 + W10: first/last position of a token with a default, and the span of the article
    between its begin and end ids."""
    lay = _laid(spark, sf)
    start, stop, _ = E.extract_target("input_ids", SP["begin_article"], SP["end_article"])
    return lay.select("doc_id",
                      E.token_position("input_ids", SP["begin_article"]).alias("first_article"),
                      E.token_position("input_ids", SP["end_article"], first=False).alias("last_end_article"),
                      start.alias("start_ind"), stop.alias("end_ind"))


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    conv = K.table(spark, sf, "conversations").where(F.col("role") == "user")
    return conv.select("conv_id", "turn", "text")


@register("gen_context", f"""
WITH c AS (SELECT conv_id, turn, {_wrap_sql(word_ids_sql('text'), 'title')} AS p_title,
                  {_wrap_sql(word_ids_sql('text'), 'article')} AS p_article FROM conversations WHERE role = 'user'),
x AS (SELECT conv_id, turn, list_concat(list_concat(p_title, p_article)[1:{fixed.GENERATION_CONTEXT_LIMIT}], [{SP['begin_summary']}]) AS context FROM c)
SELECT conv_id, turn, draw_index, CAST(draw_index // 2 AS INTEGER) AS chunk, len(context) AS n_ctx,
       array_to_string(context, ' ') AS context
FROM x, (SELECT range AS draw_index FROM range(4))""")
def gen_context(spark: SparkSession, sf: str) -> DataFrame:
    """Q8 + P20 + Q15: generation contexts of user turns (title and article from the turn, target
    summary) cut to 1020 ids + begin id, repeated for a batch of 4 draws in chunks of 2."""
    p = _prompts(spark, sf)
    p = p.select("conv_id", "turn",
                 Q.wrap(word_ids("text"), SP["begin_title"], SP["end_title"]).alias("p_title"),
                 Q.wrap(word_ids("text"), SP["begin_article"], SP["end_article"]).alias("p_article"))
    p = p.withColumns({c: F.lit(None).cast("array<int>") for c in ("p_domain", "p_date", "p_authors")})
    ctx = Q.generation_context(p, "summary", SP["begin_summary"])
    rep = Q.repeat_prompts(ctx, batch_size=4, max_batch=2)
    return rep.select("conv_id", "turn", "draw_index", "chunk", F.size("context").alias("n_ctx"),
                      F.array_join("context", " ").alias("context"))


def _gen_sql(steps: int = 16, top_p: float = 0.95, eos: str = "the", seed: int = 0) -> str:
    from newsloom.plans.sample_queries import COUNTS
    u = (f"(('0x' || substr(md5('{seed}' || '|' || 'gen' || CAST(g.step + 1 AS VARCHAR) || '|' || g.prompt_id), 1, 8))::BIGINT"
         f" / 4294967296.0)")
    return f"""
WITH RECURSIVE c AS {COUNTS},
kept AS (SELECT prev, token, n FROM (
    SELECT *, row_number() OVER w AS rank, sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
           sum(n) OVER (PARTITION BY prev) AS tot
    FROM c WINDOW w AS (PARTITION BY prev ORDER BY n DESC, token)) WHERE cum < {top_p} * tot OR rank = 1),
prompts AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS prompt_id,
                   coalesce(regexp_extract_all(text, {S.q(WORDS)})[-1], '{MD.BOS}') AS last
            FROM conversations WHERE role = 'user'),
gen(step, prompt_id, token) AS (
  SELECT -1, prompt_id, last FROM prompts
  UNION ALL
  SELECT step, prompt_id, token FROM (
    SELECT step, prompt_id, token, row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, token) AS r FROM (
      SELECT g.step + 1 AS step, g.prompt_id, k.token, k.n,
             sum(k.n) OVER (PARTITION BY g.prompt_id ORDER BY k.n DESC, k.token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(k.n) OVER (PARTITION BY g.prompt_id) AS tot, {u} AS u
      FROM gen g LEFT JOIN (SELECT DISTINCT prev FROM kept) x ON x.prev = g.token
           JOIN kept k ON k.prev = coalesce(x.prev, '{MD.BOS}')
      WHERE g.step < {steps - 1} AND (g.step = -1 OR g.token <> '{eos}'))
    WHERE cum > u * tot) WHERE r = 1)
SELECT prompt_id, count(*) AS n_generated, string_agg(token, ' ' ORDER BY step) AS text
FROM gen WHERE step >= 0 GROUP BY prompt_id"""


@register("gen_generate", _gen_sql())
def gen_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Continue every user turn with the corpus bigram model (top-p 0.95), stopping at
    the end-of-sentence word or after 16 words."""
    train = MD.word_tokens(K.table(spark, sf, "documents"), "text", "doc_id")
    counts = MD.ngram_fit(train)
    p = _prompts(spark, sf)
    last = F.try_element_at(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(-1))
    prompts = p.select(F.concat_ws(":", "conv_id", "turn").alias("prompt_id"),
                       F.coalesce(last, F.lit(MD.BOS)).alias("last"))
    gen = MD.generate(prompts, counts, "prompt_id", "last", eos="the", max_steps=16)
    return gen.select("prompt_id", F.size("generated").alias("n_generated"), F.array_join("generated", " ").alias("text"))


@register("clf_train")
def clf_train(spark: SparkSession, sf: str) -> DataFrame:
    """M2 + A4: logistic regression on hashed words of the labelled documents (train split),
    probabilities and accuracy on every split."""
    from newsloom.plans.eval_queries import examples
    ex = examples(spark, sf).join(K.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    model = MD.train_classifier(ex.where(F.col("split") == "train"))
    scored = MD.classify(model, ex)
    return E.accuracy(scored, by=["split"])


@register("gen_format_context", f"""
WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_concat(
    CASE WHEN t <> '' THEN {_wrap_sql(word_ids_sql('t'), 'title')} ELSE []::INTEGER[] END,
    CASE WHEN t <> '' THEN list_concat([{SP['begin_article']}], {word_ids_sql('t')}, [{SP['end_article']}]) ELSE []::INTEGER[] END,
    [{SP['begin_summary']}]), ' ') AS context
FROM c""")
def gen_format_context(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: generation context from raw strings (the turn is the title; the article copies the title
    because the target is the summary; empty fields are skipped)."""
    c = _prompts(spark, sf).withColumn("t", F.trim("text"))
    present = F.col("t") != ""
    c = c.select("conv_id", "turn",
                 F.when(present, Q.wrap(word_ids("t"), SP["begin_title"], SP["end_title"])).alias("p_title"),
                 F.when(present, Q.wrap(word_ids("t"), SP["begin_article"], SP["end_article"])).alias("p_title_as_article"),
                 *[F.lit(None).cast("array<int>").alias(f"p_{f}") for f in ("domain", "date", "authors")])
    ctx = Q.format_context(c, "summary", {"summary": SP["begin_summary"]})
    return ctx.select("conv_id", "turn", F.array_join("context", " ").alias("context"))


@register("date_valid", f"""
SELECT o_orderkey,
  (len(string_split(strftime(o_orderdate, '%m-%d-%Y'), '-')) = 3
     AND regexp_matches(string_split(strftime(o_orderdate, '%m-%d-%Y'), '-')[1], '^[0-9]+$')) AS date_ok,
  coalesce(len(string_split(o_orderpriority, '-')) = 3
     AND regexp_matches(string_split(o_orderpriority, '-')[1], '^[0-9]+$'), false) AS priority_as_date_ok
FROM orders""")
def date_valid(spark: SparkSession, sf: str) -> DataFrame:
    """date validity (three parts, numeric month) of formatted order dates and, as a negative
    case, of the priority strings."""
    o = K.table(spark, sf, "orders").select("o_orderkey", TX.mm_dd_yyyy("o_orderdate").alias("d"), "o_orderpriority")
    return o.select("o_orderkey", TX.valid_date("d").alias("date_ok"),
                    TX.valid_date("o_orderpriority").alias("priority_as_date_ok"))


# ------------------------------------------------------------------ tokenizer oracles (DuckDB)
WORDS_SQL = f"""(SELECT w, {byte_encode_sql('w')} AS enc, count(*) AS cnt
  FROM (SELECT unnest(pre) AS w FROM {pretokens_sql('documents', 'doc_id')}) GROUP BY w)"""
PAIRS_SQL = f"""(SELECT l AS "left", r AS "right", sum(cnt) AS n FROM (
    SELECT cnt, string_split(enc, '')[i] AS l, string_split(enc, '')[i + 1] AS r
    FROM (SELECT enc, cnt, unnest(range(1, length(enc))) AS i FROM {WORDS_SQL})) GROUP BY ALL)"""
TOP_PAIRS_SQL = f"""(SELECT (row_number() OVER (ORDER BY n DESC, "left", "right") - 1)::INTEGER AS rank, "left", "right"
  FROM {PAIRS_SQL} ORDER BY n DESC, "left", "right" LIMIT {N_MERGES})"""

ORACLES["tok_pair_counts"] = f"SELECT * FROM {PAIRS_SQL}"


def _vocab_sql() -> str:
    bytes_rows = _byte_rows()
    specials = [fixed.PADDING_TOKEN] + [t for f in fixed.SPECIAL_FIELDS for t in (f"<|begin{f}|>", f"<|endof{f}|>")] \
        + [fixed.RESET_TOKEN]
    sp_rows = ", ".join(f"({S.q(t)}, {k})" for k, t in enumerate(specials))
    return f"""SELECT token, id, starts_with(token, '<|') AND ends_with(token, '|>') AS is_special FROM (
      SELECT b_tok AS token, b_id::INTEGER AS id FROM (VALUES {bytes_rows}) bv(b_tok, b_id)
      UNION ALL SELECT "left" || "right", (rank + 257)::INTEGER FROM {TOP_PAIRS_SQL}
      UNION ALL SELECT s_tok, (CASE WHEN s_k = 0 THEN 0 ELSE (SELECT count(*) FROM {TOP_PAIRS_SQL}) + 256 + s_k END)::INTEGER
      FROM (VALUES {sp_rows}) sv(s_tok, s_k))"""


ORACLES["tok_vocab"] = _vocab_sql()

ORACLES["tok_encode"] = f"""SELECT doc_id, len(ids)::INTEGER AS n_ids, array_to_string(ids, ' ') AS ids
FROM {encode_sql('(SELECT doc_id, text FROM documents)', 'doc_id')}"""
