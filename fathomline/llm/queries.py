"""Queries of the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import html_extraction, language_id, media_columns, merkle, mixing, preference_format, quality_mil, sentencepiece_bpe, simhash, suffix_dedup
from fathomline.llm.common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the vocabularies are: FATHOMLINE_TOKENIZERS, else the installed module's folder."""
    folder = os.environ.get("FATHOMLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def remainder(of: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``of``: how the contracts set rows apart."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(remainder(5) != 0))
    found = language_id.predicted(docs.select("doc_id", "text"), model, score_col="score")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


#: How the mixing query shares out its budget.
DOMAINS, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 4, {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, 0.5, 3, 7


def domain() -> F.Column:
    """The tables name no domain: sources are dealt out to some by a checksum of their name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % DOMAINS).cast("string"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"), domain=domain(), weights=MIX_WEIGHTS, fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _ranges(mask: str) -> F.Column:
    return F.array_join(F.transform(mask, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_format.with_borrowed_answers(preference_format.turns(table(spark, sf_dir, "conversations")))
    found = preference_format.formatted(pairs)
    return found.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", _ranges("chosen_mask").alias("chosen_mask"), _ranges("rejected_mask").alias("rejected_mask"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    found = quality_mil.scored(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "top_passage", "n_passages")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.round_trips(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _op7_sql() -> str:
    def joined(items: str, by: str) -> str:
        return f"array_to_string({items}, '{by}')"

    def tree(text: str, shown: bool) -> str:
        """The hashes of a text's sections, whole or with what is below them."""
        cut = f"string_split(regexp_replace(l, '({merkle.CUT})', '\\1' || chr(1), 'g'), chr(1))"
        paragraph = "sha256(" + joined(f"list_transform({cut}, lambda x: sha256(x))", ",") + ")"
        section = "sha256(" + joined(f"list_transform(string_split(s, chr(10)), lambda l: {paragraph})", ";") + ")"
        if shown:
            paragraph = f"left({paragraph}, 8) || '-' || " + joined(f"list_transform({cut}, lambda x: left(sha256(x), 8))", ",")
            section = f"left({section}, 8) || '=' || " + joined(f"list_transform(string_split(s, chr(10)), lambda l: {paragraph})", ";")
        return joined(f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {section})", "|")

    def fp(text: str) -> str:
        return f"sha256({tree(text, False)}) || ':' || {tree(text, True)}"

    def likeness(a: str, b: str) -> str:
        x, y = (f"list_distinct(regexp_split_to_array(regexp_replace(split_part({k}, ':', 2), '[0-9a-f]+[=-]', '', 'g'), '[|;,]'))" for k in (a, b))
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"

    def nodes(x: str, by: str, backwards: bool) -> str:
        return f"list_reverse(string_split({x}, '{by}'))" if backwards else f"string_split({x}, '{by}')"

    def common(x: str, y: str) -> str:
        """The first place, counted from 1, at which two lists differ."""
        return f"coalesce(nullif(list_position(list_transform(range(1, greatest(len({x}), len({y})) + 1), lambda i: {x}[i] IS NOT DISTINCT FROM {y}[i]), false), 0), len({x}) + 1)"

    def descent(name: str, backwards: bool) -> str:
        down = []
        for k, (by, end, above) in enumerate((("|", None, None), (";", "=", 0), (",", "-", 1))):
            x, y = (f"split_part({f}, ':', 2)" if above is None else f"split_part(coalesce({v}{above}[k{above}], ''), '{end}', 2)" for f, v in (("f1", "x"), ("f2", "y")))
            at = common(f"x{k}", f"y{k}")
            down.append(f"{name}{k} AS (SELECT *, {at} AS k{k} FROM (SELECT *, {nodes(x, by, backwards)} AS x{k}, {nodes(y, by, backwards)} AS y{k} FROM {'f' if above is None else f'{name}{above}'}))")
        return ", ".join(down)

    place = "CASE WHEN f1 <> f2 THEN (k0 - 1) || '.' || (k1 - 1) || '.' || (k2 - 1) END"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
        o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
        e AS (SELECT *, left(t, n - n // 2) || left(nt, n // 2) AS et FROM o),
        f AS MATERIALIZED (SELECT doc_id, n, sha256(et) AS edited_sha256, {fp('t')} AS f1, {fp('et')} AS f2, {fp('nt')} AS f3 FROM e),
        {descent('a', False)}, {descent('z', True)}
        SELECT f.doc_id, f.n AS n_chars, f.edited_sha256, f.f1 AS fingerprint, f.f2 AS edited_fingerprint,
               {likeness('f.f1', 'f.f2')} AS near_edited, {likeness('f.f1', 'f.f3')} AS near_next, a.p AS first_edit, z.p AS last_edit
        FROM f JOIN (SELECT doc_id, {place} AS p FROM a2) a USING (doc_id) JOIN (SELECT doc_id, {place} AS p FROM z2) z USING (doc_id)"""


def _op2_sql() -> str:
    def weighed(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1 END"

    def filled(src: str, parents: str, name: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        order = f"{by} ORDER BY capacity / weight, {name}"
        return f"""
            SELECT *, CASE WHEN full_ THEN capacity ELSE greatest(0, weight * o.l // o.f) END::BIGINT AS share FROM (
              SELECT *, first_value(CASE WHEN NOT full_ THEN {{'l': left_, 'f': of_}} END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o FROM (
                SELECT *, capacity * of_ <= weight * left_ AS full_ FROM (
                  SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_,
                         (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS of_ FROM {src})))"""

    # crc32 isn't at hand in this SQL: the few sources' domains are stated by name.
    import zlib

    names = ["", *(f"src{k}" for k in range(1000))]
    domains = " UNION ALL ".join(f"SELECT '{n}' AS source, 'domain{zlib.crc32(n.encode()) % DOMAINS}' AS domain" for n in names)
    leaf = "domain, lang, source"
    return f"""
        WITH doms AS ({domains}),
        r AS (SELECT doc_id, domain, coalesce(lang, '') AS lang, coalesce(d.source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{mixing.TOKEN}'))::BIGINT AS n_tokens
              FROM documents d JOIN doms ON coalesce(d.source, '') = doms.source),
        leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {MIX_EPOCHS} AS capacity FROM r GROUP BY ALL),
        b AS (SELECT floor(sum(tokens) * {MIX_FRACTION}::DOUBLE)::BIGINT AS total FROM leaves),
        n1 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, any_value(total) AS budget, {weighed('domain')} AS weight FROM leaves, b GROUP BY domain),
        s1 AS (SELECT domain, share AS budget FROM ({filled('n1', '', 'domain')})),
        n2 AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, any_value(budget) AS budget, {weighed('lang')} AS weight FROM leaves JOIN s1 USING (domain) GROUP BY domain, lang),
        s2 AS (SELECT domain, lang, share AS budget FROM ({filled('n2', 'domain', 'lang')})),
        n3 AS (SELECT l.*, budget, 1 AS weight FROM leaves l JOIN s2 USING (domain, lang)),
        s3 AS (SELECT {leaf}, tokens, share, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest FROM ({filled('n3', 'domain, lang', 'source')})),
        k AS (SELECT r.*, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN s3 USING ({leaf})),
        c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
        SELECT doc_id, {leaf}, n_tokens, epochs::BIGINT AS epochs, greatest(0, least(n_tokens, rest - before))::BIGINT AS extra_tokens FROM c"""


def _op4_sql() -> str:
    def text(x: str, when: str) -> str:
        return f"coalesce(string_agg('<|im_start|>' || r || chr(10) || {x} || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (WHERE {when}), '')"

    def mask(at: str, x: str) -> str:
        return f"coalesce(string_agg(({at} + 13 + length(r)) || '-' || ({at} + 23 + length(r) + length({x})), ',' ORDER BY k) FILTER (WHERE k > n AND r = 'assistant'), '')"

    def before(x: str) -> str:
        return f"coalesce(sum(CASE WHEN k > n THEN 24 + length(r) + length({x}) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"

    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
                   FROM conversations WHERE conv_id IS NOT NULL),
        la AS (SELECT conv_id, max(k) FILTER (WHERE r = 'assistant') AS la FROM t GROUP BY conv_id),
        lt AS (SELECT t.conv_id, x FROM t JOIN la ON t.conv_id = la.conv_id AND k = la),
        o AS (SELECT conv_id, la, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS nx FROM la),
        b AS (SELECT o.conv_id, la, coalesce(lt.x, '') AS borrowed FROM o LEFT JOIN lt ON lt.conv_id = o.nx),
        p AS (SELECT t.conv_id, k, r, x, CASE WHEN k = la THEN borrowed ELSE x END AS y FROM t JOIN b USING (conv_id)),
        n AS (SELECT *, coalesce(min(CASE WHEN x <> y THEN k END) OVER (PARTITION BY conv_id) - 1, max(k) OVER (PARTITION BY conv_id)) AS n FROM p),
        m AS (SELECT *, {before('x')} AS bx, {before('y')} AS bz FROM n)
        SELECT conv_id, any_value(n)::INT AS prompt_turns, {text('x', 'k <= n')} AS prompt, {text('x', 'k > n')} AS chosen, {text('y', 'k > n')} AS rejected,
               {mask('bx', 'x')} AS chosen_mask, {mask('bz', 'y')} AS rejected_mask FROM m GROUP BY conv_id"""


def _op9_sql() -> str:
    """Containers of one track put together box by box as hex digits, apart from the operator's writer; every header is 593
    bytes and four for each keyframe and chunk and twelve for each run of chunks."""
    import struct

    def u32(x: str) -> str:
        return f"printf('%08x', {x})"

    def const(*parts: int | bytes) -> str:
        return b"".join(struct.pack(">I", p) if isinstance(p, int) else p for p in parts).hex()

    def box(kind: str, name: str) -> str:
        """A column of hex digits in a box."""
        return f"{u32(f'8 + length({name}) // 2')} || '{kind.encode().hex()}' || {name}"

    def full(kind: str, body: str, flags: int = 0) -> str:
        return f"(SELECT {u32('8 + length(b) // 2')} || '{kind.encode().hex()}' || b FROM (SELECT '{flags:08x}' || {body} AS b))"

    unity = const(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = bytes(6) + b"\0\1" + bytes(16) + bytes.fromhex("0018001800480000004800000000000000" + "01") + bytes(32) + bytes.fromhex("0028ffff")
    entry = const(8 + len(entry), b"raw ", entry)
    crc = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        crc.append(k)
    return f"""
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    n AS (SELECT *, length(x) // 2 AS size, greatest(1, (length(x) // 2 + 575) // 576) AS n FROM d),
    p AS (SELECT doc_id, size, n, x || repeat('ff', (n * 576 - size)::INT) AS pay, (n + 9) // 10 AS chunks, n % 10 AS rest, (n + 11) // 12 AS nk, (n >= 10)::INT + (n % 10 > 0)::INT AS ns FROM n),
    t AS (SELECT *, '{const(24, b"ftyp", b"isom", 512, b"isom", b"mp41")}' AS ftyp, 593 + 4 * nk + 12 * ns + 4 * chunks AS first FROM p),
    s AS (SELECT *, {full('stsd', f"'00000001{entry}'")} || {full('stts', f"'00000001' || {u32('n')} || '00000001'")}
               || {full('stss', f"{u32('nk')} || array_to_string(list_transform(range(nk), lambda k: {u32('12 * k + 1')}), '')")}
               || {full('stsc', f"{u32('ns')} || CASE WHEN n >= 10 THEN '000000010000000a00000001' ELSE '' END || CASE WHEN rest > 0 THEN {u32('chunks')} || {u32('rest')} || '00000001' ELSE '' END")}
               || {full('stsz', f"'{const(576)}' || {u32('n')}")} || {full('stco', f"{u32('chunks')} || array_to_string(list_transform(range(chunks), lambda k: {u32('first + 5760 * k')}), '')")} AS stbl0 FROM t),
    m AS (SELECT *, {box('stbl', 'stbl0')} AS stbl FROM s),
    i AS (SELECT *, '{const(20, b"vmhd", 1, bytes(8))}' || '{const(36, b"dinf", 28, b"dref", 0, 1, 12, b"url ", 1)}' || stbl AS minf0 FROM m),
    a AS (SELECT *, {full('mdhd', f"'{const(0, 0, 25)}' || {u32('n')} || '55c40000'")} || '{const(39, b"hdlr", 0, 0, b"vide", bytes(12), b"frames", bytes(1))}' || {box('minf', 'minf0')} AS mdia0 FROM i),
    k AS (SELECT *, {full('tkhd', f"'{const(0, 0, 1, 0)}' || {u32('n')} || '{const(bytes(16), bytes.fromhex(unity), 24 << 16, 24 << 16)}'", 3)} || {box('mdia', 'mdia0')} AS trak0 FROM a),
    v AS (SELECT *, {full('mvhd', f"'{const(0, 0, 25)}' || {u32('n')} || '{const(0x10000, bytes.fromhex('0100'), bytes(10), bytes.fromhex(unity), bytes(24), 2)}'")} || {box('trak', 'trak0')} AS moov0 FROM k),
    h AS (SELECT *, {box('moov', 'moov0')} AS moov FROM v),
    z AS (SELECT *, ftyp || moov || {u32('576 * n + 8')} || '{b"mdat".hex()}' || pay AS media, list_transform(range(32), lambda j: ('0x' || substr(pay, (length(pay) - 64 + 2 * j + 1)::INT, 2))::BIGINT) AS tail FROM h)
    SELECT doc_id, size AS n_bytes, 576 * n AS payload_bytes, sha256(unhex(pay)) AS payload_sha256,
           xor(list_reduce(list_prepend(4294967295::BIGINT, tail), lambda c, b: xor(c >> 8, ({crc}::BIGINT[])[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS tail_crc32,
           length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
           'raw 24x24 ' || n || ' frames ' || printf('%.2f', n / 25.0::DOUBLE) || ' s keys ' || array_to_string(list_transform(range(nk), lambda k: (first + 6912 * k) || '-' || (first + 6912 * k + 576)), ',') AS feature FROM z"""


#: Every window of 50 bytes by a hash, texts as hex digits, cut into pieces first since a substring of a long text is slow.
_OP10_SQL = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    n AS (SELECT *, length(hx) // 2 AS nb FROM d),
    q AS (SELECT doc_id, nb, base, substr(hx, 2 * base + 1, 698) AS part FROM (SELECT *, unnest(range(0, nb - 49, 300)) AS base FROM n WHERE nb >= 50)),
    w AS (SELECT doc_id, base + s AS s, hash(substr(part, 2 * s + 1, 100)) AS g FROM (SELECT *, unnest(range(least(300, nb - 49 - base))) AS s FROM q)),
    f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
    m AS (SELECT w.doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY w.doc_id ORDER BY s), -1000) > 50 AS starts FROM w JOIN f USING (g) WHERE first < w.doc_id),
    i AS (SELECT doc_id, s, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m),
    r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, island),
    p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
    k AS (SELECT p.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN n USING (doc_id) GROUP BY p.doc_id)
    SELECT n.doc_id, nb AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM n LEFT JOIN k ON k.doc_id = n.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op9_media_columns": _op9_sql(), "op10_suffix_array_dedup": _OP10_SQL, "op4_preference_format": _op4_sql(), "op2_mixing": _op2_sql(), "op7_merkle_fingerprints": _op7_sql()}
