"""Queries of the text problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.canonical import map_values
from cuewright.llm.encoding import garbled_records
from cuewright.llm.markup import find_markup, strip_markup
from cuewright.llm.packing import pack_items, pack_summary, token_counts
from cuewright.llm.residue import label_residue
from cuewright.llm.runs import event_runs
from cuewright.llm.tokens import encode_corpus
from cuewright.runtime import table


def _events(spark: SparkSession, sf_dir: str, srt_name: str, ass_name: str) -> DataFrame:
    srt = table(spark, sf_dir, "subtitle_events").select(F.lit(srt_name).alias("source"), F.lit(False).alias("ass"), "path", "seq", "text", "start_ms", "end_ms")
    ass = table(spark, sf_dir, "ass_events").select(F.lit(ass_name).alias("source"), F.lit(True).alias("ass"), "path", "seq", F.col("fields").alias("text"), "start_ms", "end_ms")
    return srt.unionByName(ass)


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(_events(spark, sf_dir, "srt", "ass"), ["source", "path"], "seq", "text", "start_ms", "end_ms", "ass")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_runs(spark, sf_dir).select("source", "path", "first_seq", "last_seq")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "tracks").select(F.lit("tracks").alias("source"), F.col("track_uid").alias("record_id"), "language")
    patches = table(spark, sf_dir, "track_patches").select(F.lit("track_patches").alias("source"), F.col("patch_id").alias("record_id"), "language")
    ref = table(spark, sf_dir, "language_ref")
    given = tracks.unionByName(patches).where(F.trim("language") != "").groupBy("source", "record_id", "language").agg(F.lit(1).alias("_one")).drop("_one")
    free = given.join(ref.select(F.col("lang_code").alias("language")), "language", "left_anti")
    mapped = map_values(free, "language", ref, "lang_code", ["lang_code", "alt_code", "short_code", "lang_name", "native_name"])
    return free.join(mapped, "language").select("source", "record_id", F.col("code").alias("lang_code")).distinct()


def _named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, text, pos in (("subtitle_events", "text", "seq"), ("tracks", "name", "track_index"), ("chapters", "title", "node")):
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("source"), "path", F.col(pos).cast("int").alias("pos"), F.col(text).alias("text")))
    # The pool of a path is its top folder: where its files came from.
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("origin", F.regexp_extract("path", "^/?([^/]*)/", 1))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = garbled_records(_named_texts(spark, sf_dir), ["source", "path", "pos"], "text", "origin", "source")
    return found.select("source", "path", "pos").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_records(_named_texts(spark, sf_dir), ["source", "path", "pos"], "text", "origin", "source", repaired=True).select("source", "path", "pos", "chain", "restored_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_markup(_events(spark, sf_dir, "subtitle_events", "ass_events"), ["source", "path", "seq"], "text", "ass")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_markup(_events(spark, sf_dir, "subtitle_events", "ass_events"), ["source", "path", "seq"], "text", "ass")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


#: More pack sizes than this would be an input of another kind; the list is read to the driver.
MOST_PACK_SIZES = 1000


def p9_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = [tuple(r) for r in table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").distinct().limit(MOST_PACK_SIZES + 1).collect()]
    if len(sizes) > MOST_PACK_SIZES:
        raise ValueError(f"more than {MOST_PACK_SIZES} pack sizes")
    counted = token_counts(docs, ["doc_id"], "text")
    return pack_items(counted, "doc_id", "n_tokens", "n_loss_tokens", sizes, n_items=docs.count())


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_summary(p9_packs(spark, sf_dir), "doc_id").select("pack_id", "capacity", "n_keys", "n_over_tokens", "n_over_segments", "n_over_loss", "n_divided")


def p10_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_labels(spark, sf_dir).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p8_ids": p8_ids,
    "p9_packs": p9_packs,
    "p9_limits": p9_limits,
    "p10_found": p10_found,
    "p10_labels": p10_labels,
}

#: Written apart from the operators, with plain patterns over the texts.
SQL: dict[str, str] = {
    # The edit distance is the full table of costs, a row at a time: the built-in one counts bytes.
    "p1_found": r"""
        with recursive ev as (
          select distinct 'srt' as source, false as ass, path, seq, text as body from subtitle_events
          union all
          select distinct 'ass', true, path, seq, case when len(string_split(fields, ',')) >= 7 then array_to_string(string_split(fields, ',')[7:], ',') end from ass_events),
        v as (select source, path, seq, regexp_replace(regexp_replace(regexp_replace(replace(body, '&nbsp;', ' '), '</?[A-Za-z][^<>]*>|<!--.*?-->', '', 'gs'), case when ass then '\{[^{}]*\}' else '\{\s*\\[^{}]*\}|\{[A-Za-z]:[^{}]*\}' end, '', 'g'), '\\[Nnh]', ' ', 'g') as t from ev),
        f as (select source, path, seq, nullif(regexp_replace(replace(replace(lower(nfc_normalize(t)), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]', '', 'g'), '') as form from v),
        g as (select *, lag(form) over (partition by source, path order by seq) as b from f),
        pairs as (select distinct form as a, b from g where form <> b and length(form) >= 12 and length(b) >= 12 and abs(length(form) - length(b)) <= 2 and levenshtein(form, b) <= 8 and regexp_extract_all(form, '[0-9]+') = regexp_extract_all(b, '[0-9]+')),
        dp(a, b, i, costs) as (
          select a, b, 0, range(0, length(b) + 1) from pairs
          union all
          select a, b, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda acc, x: list_append(acc, least(acc[-1] + 1, costs[x[1] + 1] + 1, costs[x[1]] + case when a[i + 1] = b[x[1]] then 0 else 1 end))) from dp where i < length(a)),
        near as (select a, b from dp where i = length(a) and costs[-1] <= 2),
        h as (select g.*, case when form = g.b or near.a is not null then 0 else 1 end as opens from g left join near on near.a = form and near.b = g.b),
        r as (select *, sum(opens) over (partition by source, path order by seq rows unbounded preceding) as run from h)
        select source, path, min(seq) as first_seq, max(seq) as last_seq from r group by source, path, run having count(*) > 1""",
    # Here by the edit distance: whole readings first, then abbreviations, then the one nearest entry.
    "p3_found": r"""
        with recursive given as (
          select distinct 'tracks' as source, track_uid as record_id, language from tracks where trim(language) <> ''
          union select distinct 'track_patches', patch_id, language from track_patches where trim(language) <> ''),
        free as (select * from given where language not in (select lang_code from language_ref)),
        terms as (select distinct code, unnest([term, strip_accents(term)]) as term from (select lang_code as code, trim(lower(nfc_normalize(regexp_replace(unnest([lang_code, alt_code, short_code, lang_name, native_name]), '[\x{00AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'))), ' .,;:!?*#-') as term from language_ref)),
        vals as (select distinct language, trim(lower(nfc_normalize(regexp_replace(language, '[\x{00AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'))), ' .,;:!?*#-') as whole, ends_with(trim(language), '.') and not contains(trim(language), ' ') as abbreviated from free),
        parts as (
          select language, 0 as place, whole as form, true as loose from vals
          union all select language, 1 + i, trim(lower(nfc_normalize(regexp_replace(part, '[\x{00AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'))), ' .,;:!?*#-'), true from (select language, unnest(list) as part, unnest(range(len(list))) as i from (select language, regexp_split_to_array(lower(nfc_normalize(language)), '\s*[/,;:=|()\[\]_&+]+\s*|\s+[-–—]+\s+|[-–—]') as list from vals))
          union all select language, 100 + i, trim(lower(nfc_normalize(regexp_replace(word, '[\x{00AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'))), ' .,;:!?*#-'), false from (select language, unnest(list) as word, unnest(range(len(list))) as i from (select language, regexp_split_to_array(lower(nfc_normalize(language)), '[\s/,;:=|()\[\]_&+–—-]+') as list from vals))),
        exact as (select language, arg_min(code, place) as code from parts join terms on form = term group by language),
        rest as (select distinct language, form from parts where loose and length(form) >= 4 and language not in (select language from exact)),
        pairs as (select distinct form as a, term as b from rest, terms where length(term) > 3 and abs(length(form) - length(term)) <= 2),
        dp(a, b, i, costs) as (
          select a, b, 0, range(0, length(b) + 1) from pairs
          union all
          select a, b, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, length(b) + 1), lambda j: [j])), lambda acc, x: list_append(acc, least(acc[-1] + 1, costs[x[1] + 1] + 1, costs[x[1]] + case when a[i + 1] = b[x[1]] then 0 else 1 end))) from dp where i < length(a)),
        near as (select a, b, costs[-1] as cost from dp where i = length(a) and costs[-1] <= case when length(a) >= 5 then 2 else 1 end),
        short as (select language, min(code) as code from vals join terms on abbreviated and length(whole) >= 3 and starts_with(term, whole) group by language having count(distinct code) = 1),
        fuzzy as (select language, code, min(cost) as cost from rest join near on form = a join terms on term = b where language not in (select language from short) group by language, code),
        best as (select language, min(code) as code from (select *, min(cost) over (partition by language) as least_cost from fuzzy) where cost = least_cost group by language having count(*) = 1)
        select source, record_id, coalesce(e.code, s.code, b.code, 'none') as lang_code from free left join exact e using (language) left join short s using (language) left join best b using (language)""",
    "p6_found": r"""
        with ev as (
          select distinct 'subtitle_events' as source, false as ass, path, seq, text as body from subtitle_events
          union all
          select distinct 'ass_events', true, path, seq, case when len(string_split(fields, ',')) >= 7 then array_to_string(string_split(fields, ',')[7:], ',') end from ass_events),
        shown as (select source, path, seq, ass, case when ass then regexp_replace(body, '\\N', chr(10), 'g') else body end as t, body from ev)
        select distinct source, path, seq from shown where
          regexp_matches(t, '</?[A-Za-z][^<>]*>|<!--') or regexp_matches(t, '&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);') or regexp_matches(t, '\{\s*\\|\{[A-Za-z]:') or (ass and regexp_matches(body, '\{|\\[Nnh]'))
          or regexp_matches(t, '\\[A-Za-z&%$#_(\[]') or regexp_matches(t, '\*\*[^*\n]+\*\*|~~[^~\n]+~~|`[^`\n]+`|```|\]\([^()\n]*\)|\[\[[^\[\]]+\]\]|\{\{[^{}]*\}\}')
          or regexp_matches(t, '(?m)^\{\||^#{1,6} |^[*+] |^> |^\|.*\|$|^={2,6} .* ={2,6}$|^={3,}$') or regexp_matches(t, '(?s)(^|\n)[0-9]{1,3}\. .*\n[0-9]{1,3}\. ')
          or regexp_matches(t, '''''[^'']+''''|``[^`'']+''''') or regexp_matches(t, '(^|[^A-Za-z0-9$])\$\$?[^0-9 $\n][^$\n]*[^ $\n]\$') or regexp_matches(t, '(^|[^A-Za-z0-9_])_[^ _][^_\n]*_($|[^A-Za-z0-9_])')""",
    # Every text in packs of each size, no limit broken, nothing divided that fits.
    "p9_limits": """
        select pack_id, cast(capacity_tokens as bigint) as capacity, (select count(distinct doc_id) from documents) as n_keys, cast(0 as bigint) as n_over_tokens, cast(0 as bigint) as n_over_segments, cast(0 as bigint) as n_over_loss, cast(0 as bigint) as n_divided
        from (select distinct * from pack_sizes)""",
    "p10_found": r"""
        select doc_id from documents where
          regexp_matches(text, '\{\{[^{}]*\}\}|\{%[^{}]*%\}|<%[^<>]*%>|[$#]\{[^{}]*\}|%\([a-z_.]+\)s|\[\[[A-Z_. ]+\]\]|@@[a-z_.]+@@|__[A-Z_.]+__|%[A-Z_.]+%|\$[A-Z_.]+\$|«[a-z]+([_.][a-z]+)*»|\{[a-z_.]+\}|<[a-z ]+ here>|\[(INSERT|TK) [^\]]*\]|\[[a-z ]+ to be inserted\]|XXX')
          or regexp_matches(text, '(?i)(not found|page missing|gone|forbidden|service unavailable|bad gateway|gateway timed out|too many requests|internal server error)(\n|$|\.? *(\||$)|\.? (the server|something went|please|retry|request id|unhandled|undefined|warning|the archive|we cannot|the [a-z]+ |this [a-z]+ has|you do not|we noticed|confirm|seite|ein interner|der zugriff|das gew|la page|erreur|veuillez|página|compruebe|el servicio|your session|sign in|back to|search|contact|home|sitting|status|error|[a-z]+ not found))')
          or regexp_matches(text, '(?i)error [0-9]{3}($|\n|\.| [^,]{0,40}(\.|\n|$|\|))|server (could not complete|refused|gave up on) your request|went wrong on our side|please try again later|retry after [0-9]+ seconds|request id [0-9a-f]+|unhandled exception in|undefined variable|did not answer within|we cannot find that|does not exist on this server|unusual traffic|not a robot|you asked for could not|has been moved or deleted|do not have permission to view')
          or regexp_matches(text, '(?i)seite nicht gefunden|interner fehler ist aufgetreten|zugriff wurde verweigert|protokoll ist nicht verfügbar|demandée est introuvable|erreur interne du serveur|veuillez réessayer|página no encontrada|compruebe la dirección|servicio no está disponible')
          or regexp_matches(text, '(?i)(please enable|activate|turn on|switch on|need to enable|must allow|veuillez activer|aktivieren sie|active|needs|requires|relies on|allow) (javascript|scripts|client-side scripting)($|[^a-z])')
          or regexp_matches(text, '(?i)(javascript|scripts|scripting) (is|are|may be) (required|blocked|disabled|turned off|not supported)|browser is out of date|change your settings and reload|loading (this|the) [a-z]+(\.|…|\n|$)')
          or regexp_matches(text, '(?i)we use cookies|manage choices|(accept|agree) to read|sign in to continue|subscribe or log in|your session has expired|bitte melden sie sich an|vous connecter|inicie sesión|identifíquese')
          or regexp_matches(text, '(?i)(dolor|adipiscing|eiusmod|ullamco|incididunt|consectetur)|((asdf|qwer|foo bar|text|blah|test|aaa|xyz|lorem)( |$)){3}')
          or regexp_matches(text, '(?i)sample (transcript|speech|contribution|remarks|paragraph|body text)|goes here|text of the [a-z ]+ to follow|in this box|, do not publish|before release|beispieltext|hier steht später|platzhalter für|texte provisoire|à compléter par|texte d’exemple|texto de relleno|sustituir por|this is a placeholder for')""",
}

#: The same runs with their number of events and times.
SQL["p1_runs"] = (
    SQL["p1_found"]
    .replace("false as ass, path, seq, text as body", "false as ass, path, seq, start_ms, end_ms, text as body")
    .replace("select distinct 'ass', true, path, seq, case", "select distinct 'ass', true, path, seq, start_ms, end_ms, case")
    .replace("v as (select source, path, seq,", "v as (select source, path, seq, start_ms, end_ms,")
    .replace("f as (select source, path, seq,", "f as (select source, path, seq, start_ms, end_ms,")
    .replace("max(seq) as last_seq from r", "max(seq) as last_seq, count(*) as n_events, min(start_ms) as start_ms, max(end_ms) as end_ms, max(end_ms) - min(start_ms) as duration_ms from r")
)
