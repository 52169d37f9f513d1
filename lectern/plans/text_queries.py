"""Text, date, path and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import chunking, dates, paths, text
from lectern.plans.core_queries import register
from lectern.session import table

_W = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\x{{00A0}}\x{{0085}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '')"
W = _W.format("content")
_SP = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = rf"regexp_replace({{0}}, '^{_SP.replace('{', '{{').replace('}', '}}')}+|{_SP.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@register("word_count", f"SELECT doc_id, len({W})::BIGINT AS n_words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", text.word_count(F.col("content")).cast("long").alias("n_words"))


def _windows_sql(body: str, size: int, overlap: int) -> str:
    step = size - overlap
    w = _W.format("body")
    return f"""SELECT doc_id, (i)::BIGINT AS chunk_index, CASE WHEN len(w) <= {size} THEN body ELSE array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') END AS chunk FROM (
      SELECT doc_id, body, w, unnest(range(0, greatest(CAST(ceil((len(w) - {overlap})::DOUBLE / {step}) AS BIGINT), 1))) AS i FROM (SELECT doc_id, body, {w} AS w FROM ({body})) WHERE len(w) > 0)"""


@register("chunk_windows", _windows_sql("SELECT doc_id, content AS body FROM documents", 120, 20))
def chunk_windows(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(chunking.windows(F.col("content"), 120, 20)).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("chunk_plain", f"SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM (SELECT doc_id, '' AS chunk FROM documents WHERE {_TRIM.format("coalesce(content, '')")} = '' UNION ALL SELECT doc_id, chunk FROM ({_windows_sql('SELECT doc_id, ' + _TRIM.format('content') + ' AS body FROM documents', 120, 20)})) GROUP BY doc_id")
def chunk_plain(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.explode(chunking.plain_chunks(F.col("content"), 120, 20)).alias("chunk"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("chunk")).alias("chars"))


@register("chunk_count_per_doc", f"SELECT doc_id, greatest(CAST(ceil((len({W}) - 50)::DOUBLE / 450) AS BIGINT), 1) AS chunks FROM documents WHERE len({W}) > 0")
def chunk_count_per_doc(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(chunking.windows(F.col("content"), 500, 50)).cast("long").alias("chunks")).where("chunks > 0")


@register("chunk_code_window", _windows_sql("SELECT doc_id, content AS body FROM documents", 100, 0))
def chunk_code_window(spark, sf):
    """An overlap that is not smaller than the size counts as none."""
    rows = docs(spark, sf).select("doc_id", F.posexplode(chunking.windows(F.col("content"), 100, 100)).alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("chunk_paragraphs_split", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(13))), lambda p: p <> ''))::BIGINT AS paragraphs FROM documents")
def chunk_paragraphs_split(spark, sf):
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: p != "")
    return docs(spark, sf).select("doc_id", F.size(parts).cast("long").alias("paragraphs"))


@register("chunk_commit_header", "SELECT doc_id, '[' || source || '/' || coalesce(title, '') || '] [commit: ' || substring(sha256(cast(doc_id AS VARCHAR)), 1, 7) || '] [' || substring(created_at, 1, 10) || ']' AS header FROM documents WHERE source LIKE 'repo-%'")
def chunk_commit_header(spark, sf):
    rows = docs(spark, sf).where("source like 'repo-%'")
    head = chunking.commit_header(F.col("source"), F.coalesce("title", F.lit("")), F.sha2(F.col("doc_id").cast("string"), 256), F.col("created_at"))
    return rows.select("doc_id", head.alias("header"))


@register("code_chunk_header", "SELECT p_partkey, '[' || p_name || ':' || p_size || '-' || (p_size + 9) || '] [python] [function: ' || p_brand || ' > ' || p_type || ']' AS header FROM part")
def code_chunk_header(spark, sf):
    head = chunking.code_header(F.col("p_name"), F.col("p_size"), F.col("p_size") + 9, F.lit("python"), F.lit("function"), F.col("p_brand"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", head.alias("header"))


@register("md_strip_embeds", r"SELECT doc_id, regexp_replace(content, '!\[\[([^\]]+)\]\]', '', 'g') AS out FROM documents")
def md_strip_embeds(spark, sf):
    return docs(spark, sf).select("doc_id", text.strip_embeds(F.col("content")).alias("out"))


@register("md_wikilinks", r"SELECT doc_id, regexp_replace(regexp_replace(content, '\[\[\s*([^\]|]+?)\s*\|\s*([^\]]+?)\s*\]\]', '\2 (\1)', 'g'), '\[\[\s*([^\]]+?)\s*\]\]', '\1', 'g') AS out, len(regexp_extract_all(content, '\[\[([^\]]+)\]\]'))::BIGINT AS links FROM documents")
def md_wikilinks(spark, sf):
    return docs(spark, sf).select("doc_id", text.convert_wikilinks(F.col("content")).alias("out"), F.size(text.link_targets(F.col("content"))).cast("long").alias("links"))


@register("md_inline_tags", r"SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?:^|\s)#([A-Za-z0-9_][A-Za-z0-9_/\-]*)', 1)) AS tag FROM documents)")
def md_inline_tags(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(text.inline_tags(F.col("content"))).alias("tag"))


def mails(spark, sf):
    return table(spark, sf, "email_messages")


_STRIP = r"regexp_replace(regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@register("mail_strip_quotes", "SELECT mail_id, " + _STRIP.format(r"regexp_replace(regexp_replace(body_text, '(?im)^On\s+.{10,80}\s+wrote:\s*$(?s:.*)', ''), '(?m)^>.*$', '', 'g')").replace("{{", "{").replace("}}", "}") + " AS out FROM email_messages")
def mail_strip_quotes(spark, sf):
    return mails(spark, sf).select("mail_id", text.strip_quoted_replies(F.col("body_text")).alias("out"))


@register("mail_strip_signature", r"SELECT mail_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body_text, '(?m)^-- $(?s:.*)', ''), '(?im)^Sent from my (?:iPhone|iPad|Android|Galaxy).*$(?s:.*)', ''), '(?im)^Get Outlook for .*$(?s:.*)', ''), '^\s+', ''), '\s+$', '') AS out FROM email_messages")
def mail_strip_signature(spark, sf):
    return mails(spark, sf).select("mail_id", text.strip_signature(F.col("body_text")).alias("out"))


@register("mail_fallback_id", "SELECT mail_id, substring(sha256(coalesce(sender, '') || '|' || coalesce(subject, '') || '|' || coalesce(sent_date, '')), 1, 32) AS fallback_id FROM email_messages")
def mail_fallback_id(spark, sf):
    return mails(spark, sf).select("mail_id", text.fallback_message_id(F.col("sender"), F.col("subject"), F.col("sent_date")).alias("fallback_id"))


@register("mail_ticks_to_iso", "SELECT mail_id, strftime(to_timestamp(((CAST(sent_date AS HUGEINT) - 621355968000000000) // 10000000)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM email_messages WHERE regexp_full_match(sent_date, '\\d{18}')")
def mail_ticks_to_iso(spark, sf):
    return mails(spark, sf).where(F.col("sent_date").rlike(r"^\d{18}$")).select("mail_id", dates.ticks_to_iso(F.col("sent_date").cast("long")).alias("iso"))


@register("iso_to_ticks", "SELECT event_id, (epoch(date_trunc('second', ts))::BIGINT) * 10000000 + 621355968000000000 AS ticks FROM events")
def iso_to_ticks(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", dates.iso_to_ticks(stamp).alias("ticks"))


@register("feed_seconds", "SELECT articleid, CASE WHEN try_cast(datepublished AS DOUBLE) IS NOT NULL THEN round(CAST(datepublished AS DOUBLE), 3) END AS seconds FROM articles WHERE try_cast(datepublished AS DOUBLE) IS NOT NULL")
def feed_seconds(spark, sf):
    rows = table(spark, sf, "articles").where(F.col("datepublished").try_cast("double").isNotNull())
    return rows.select("articleid", F.round(dates.feed_seconds(F.col("datepublished")), 3).alias("seconds"))


@register("html_strip_basic", r"SELECT articleid, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(contenthtml, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS out FROM articles".replace('\\"', '"'))
def html_strip_basic(spark, sf):
    return table(spark, sf, "articles").select("articleid", text.html_to_text_basic(F.col("contenthtml")).alias("out"))


@register("url_host", r"SELECT articleid, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]*)', 1) AS host FROM articles WHERE url IS NOT NULL")
def url_host(spark, sf):
    return table(spark, sf, "articles").where("url is not null").select("articleid", text.url_host(F.col("url")).alias("host"))


@register("files_hidden", "SELECT id, len(list_filter(string_split(source_path, '/'), lambda p: starts_with(p, '.'))) > 0 AS hidden FROM sources")
def files_hidden(spark, sf):
    return table(spark, sf, "sources").select("id", paths.is_hidden(F.col("source_path")).alias("hidden"))


# The oracle's own values, written out here and not taken from the operator's tables.
_EXT = r"lower(regexp_extract(regexp_extract(source_path, '[^/]*$'), '\.([^.]*)$', 1))"
_KINDS = "WHEN 'md' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'dotx' THEN 'docx' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'epub' THEN 'epub'"
_KINDS += "".join(f" WHEN '{x}' THEN 'plaintext'" for x in ("txt", "csv", "json", "yaml", "yml"))
_SPOKEN = "WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'md' THEN 'markdown' WHEN 'toml' THEN 'toml' WHEN 'sql' THEN 'sql' WHEN 'css' THEN 'css'"
_SPOKEN += "".join(f" WHEN '{x}' THEN '{y}'" for y, xs in {"hcl": ("tf", "tfvars", "hcl"), "javascript": ("js", "jsx"), "c": ("c", "h"), "cpp": ("cpp", "cc", "hpp"), "bash": ("sh", "bash"), "yaml": ("yaml", "yml"), "html": ("html", "htm"), "plaintext": ("json", "txt", "csv", "rst", "xml", "scss")}.items() for x in xs)
_NAMES = "'.DS_Store', '.terraform.lock.hcl', 'go.sum', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'poetry.lock', 'uv.lock'"
_DIRS = "'.idea', '.vscode', 'node_modules', '__pycache__', '.mypy_cache', '.pytest_cache', '.tox', 'dist', 'build', '.egg-info', 'vendor', '.terraform', 'cdk.out'"


@register("source_type_for_path", f"SELECT id, CASE {_EXT} {_KINDS} ELSE '' END AS kind FROM sources")
def source_type_for_path(spark, sf):
    return table(spark, sf, "sources").select("id", paths.source_type(F.col("source_path")).alias("kind"))


@register("code_language_for_path", f"SELECT id, CASE {_EXT} {_SPOKEN} ELSE '' END AS lang FROM sources")
def code_language_for_path(spark, sf):
    return table(spark, sf, "sources").select("id", paths.code_language(F.col("source_path")).alias("lang"))


@register("should_exclude_path", f"SELECT id, regexp_extract(source_path, '[^/]*$') IN ({_NAMES}) OR list_has_any(string_split(source_path, '/'), [{_DIRS}]) AS excluded FROM sources")
def should_exclude_path(spark, sf):
    return table(spark, sf, "sources").select("id", paths.is_excluded(F.col("source_path")).alias("excluded"))


@register("chunk_markdown")
def chunk_markdown(spark, sf):
    run = chunking.markdown_chunks(120, 20)
    return docs(spark, sf).select("doc_id", F.inline(run(F.col("content"), F.col("title"))))


@register("chunk_email")
def chunk_email(spark, sf):
    run = chunking.email_chunks(120, 20)
    return mails(spark, sf).select("mail_id", F.inline(run(F.col("subject"), F.col("body_text"))))
