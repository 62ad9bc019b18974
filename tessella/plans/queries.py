"""The registered queries over the driver's tables, and their SQL.

The tables stand in for a store: `points` are documents with the embeddings of their ids, and
`objects` are documents under made-up paths, with the hash of their text as etag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ALLOWED_EXTENSIONS, EXTRACTORS, basename, extension, extractor, figure_page, is_blank, object_key, row_range
from ..operators import answer, cdc, listing, search, sentences, tables
from ..operators.chunking import sentence_chunk_rows, window_chunks
from ..operators.embedding import embed
from ..operators.index import RERANK, VectorIndex
from ..operators.metadata import payload, with_metadata
from ..sources.scratch import scratch
from ..sources.spread import spread

EXTENSIONS = ["pdf", "CSV", "docx", "doc", "xlsx", "txt", "md", "msg", "ppt", "pptx", "helm", "html", "TXT", ""]
CHOSEN = ["src1", "src2", "src3"]
QUESTION = "What do the documents say?"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents, for what works on whole texts."""
    return spread(_t(spark, sf, "documents"))


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/Doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return _t(spark, sf, "documents").select("doc_id", "source", "text", path.alias("path"), F.md5("text").alias("etag"))


_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_OBJECTS = f"(select doc_id, source, text, source || '/Doc_' || doc_id || '.' || {_EXT}[doc_id % {len(EXTENSIONS)} + 1] as path, md5(text) as etag from documents)"
_BASE = "regexp_extract(path, '[^/]*$')"
_SUFFIX = f"lower(regexp_extract({_BASE}, '^.+\\.([^.]+)$', 1))"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return d.join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def _vector(spark: SparkSession, sf: str) -> list[float]:
    """The question's vector: that of vec_id 0, one row."""
    return list(_t(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_POINTS = "(select d.doc_id, d.text, d.source, d.lang, e.embedding from documents d join embeddings e on d.doc_id = e.vec_id)"
_SCORED = f"(select *, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as s from {_POINTS})"


def _top(where: str = "true", source: str = _SCORED, k: int = 4) -> str:
    return f"(select *, row_number() over (order by s desc, doc_id) as rank from {source} where {where} order by s desc, doc_id limit {k})"


def _hits(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    return search.topk(_points(spark, sf), _vector(spark, sf), search.ASK_K, names, id="doc_id")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "source", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"select doc_id, source, round(s, 6) as score, rank from {_top()}")
def topk_cosine(spark, sf):
    return _shown(_hits(spark, sf))


@query(f"select doc_id, source, round(s, 6) as score, rank from {_top("source in ('src1', 'src2', 'src3')")}")
def topk_filtered(spark, sf):
    return _shown(_hits(spark, sf, CHOSEN))


@query(
    f"""with twice as (select * from {_SCORED} union all select * from {_SCORED}),
    h as (select *, row_number() over (partition by text, source order by s desc, doc_id) as n from {_top(source="twice")})
    select doc_id, source, round(s, 6) as score, row_number() over (order by s desc, doc_id) as rank from h where n = 1"""
)
def search_dedup(spark, sf):
    """The limit comes before the dedup, so a point that is stored twice takes two places."""
    p = _points(spark, sf)
    return _shown(search.drop_repeats(search.topk(p.unionAll(p), _vector(spark, sf), search.ASK_K, id="doc_id"), "doc_id"))


@query(
    f"""with twice as (select * from {_SCORED} union all select * from {_SCORED}),
    u as (select text, source, max(s) as s from twice group by text, source)
    select source, md5(text) as text_md5, round(s, 6) as score from u order by s desc, text limit 4"""
)
def search_dedup_first(spark, sf):
    p = _points(spark, sf)
    hits = search.topk(p.unionAll(p), _vector(spark, sf), search.ASK_K, unique=True, id="doc_id")
    return hits.select("source", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"))


_CITED = f"(select rank as index, text, source, '?' as page_number from {_top()})"


@query(f"select * from {_CITED}")
def citations(spark, sf):
    return answer.citations(_hits(spark, sf)).withColumn("index", F.col("index").cast("long"))


_CONTEXT = f"(select string_agg('[' || index || '] ' || text || chr(10) || chr(10), '' order by index) as context from {_CITED})"


@query(f"select context from {_CONTEXT}")
def numbered_context(spark, sf):
    return answer.numbered_context(answer.citations(_hits(spark, sf)))


@query("select '" + answer.PROMPT.replace("'", "''") + f"' || context || chr(10) || 'Question:' || chr(10) || '{QUESTION}' || chr(10) as prompt from {_CONTEXT}")
def prompt(spark, sf):
    return numbered_context(spark, sf).select(answer.prompt_for(F.col("context"), QUESTION).alias("prompt"))


@query(f"select * from {_CITED} where source in ('src0', 'src5')")
def citations_post_filter(spark, sf):
    return answer.only_selected(citations(spark, sf), ["a/src0", "src5"])


@query(f"select doc_id, source from {_POINTS} p where not exists (select 1 from (values ('src1'), ('src2'), ('src3')) d(source) where d.source = p.source)")
def delete_by_source(spark, sf):
    dead = spark.createDataFrame([(s,) for s in CHOSEN], "source string")
    return _points(spark, sf).select("doc_id", "source").join(dead, "source", "left_anti")


@query(f"select doc_id from {_POINTS} where source = 'src1'")
def scroll_ids(spark, sf):
    return _points(spark, sf).where("source = 'src1'").select("doc_id")


@query(f"select count(*) as vectors_count, count(distinct source) as sources, max(len(embedding))::bigint as dimension from {_POINTS}")
def collection_stats(spark, sf):
    return _points(spark, sf).agg(F.count("*").alias("vectors_count"), F.countDistinct("source").alias("sources"), F.max(F.size("embedding")).cast("long").alias("dimension"))


_CHUNKS = r"""(with w as (select doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as words from documents),
  p as (select *, unnest(range(0, cast(ceil(greatest(len(words) - 550, 0) / 450.0) as bigint) + 1)) as chunk_idx from w where len(words) > 0)
  select doc_id, source, chunk_idx, array_to_string(words[chunk_idx * 450 + 1 : chunk_idx * 450 + 550], ' ') as text,
    count(*) over (partition by doc_id) as len from p)"""


def _chunks(spark, sf):
    return window_chunks(_texts(spark, sf).select("doc_id", "source", "text"))


@query(f"select doc_id, chunk_idx, text from {_CHUNKS}")
def chunk_window(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")


@query(f"select doc_id, chunk_idx, source || chunk_idx as key, len, 'txt' as file_format from {_CHUNKS}")
def chunk_meta(spark, sf):
    named = _chunks(spark, sf).withColumn("file", F.col("source"))
    rows = with_metadata(named.withColumn("source", F.concat("file", F.lit(".txt"))), ["doc_id"])
    return rows.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), object_key(F.col("file"), F.col("chunk_idx")).alias("key"), F.col("len").cast("long").alias("len"), "file_format")


@query(f"select doc_id, regexp_replace({_BASE}, '[^a-zA-Z0-9]', '', 'g') || doc_id as key from {_OBJECTS}")
def object_keys(spark, sf):
    return _objects(spark, sf).select("doc_id", object_key(basename(F.col("path")), F.col("doc_id")).alias("key"))


_NUMBERED = "(select doc_id, doc_id || ': ' || replace(text, chr(10), chr(10) || n_chars || ': ') as text, text as plain from documents)"


@query(
    f"""select doc_id, k as numbered, coalesce(try_cast(trim(split_part(l[1], ':', 1)) as integer) || ' - ' || try_cast(trim(split_part(l[-1], ':', 1)) as integer), 'unknown') as row_range
    from (select doc_id, true as k, string_split(text, chr(10)) as l from {_NUMBERED} union all select doc_id, false, string_split(plain, chr(10)) from {_NUMBERED})"""
)
def row_ranges(spark, sf):
    d = _t(spark, sf, "documents")
    numbered = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), F.col("n_chars").cast("string"), F.lit(": "))))
    both = d.select("doc_id", F.lit(True).alias("numbered"), numbered.alias("text")).unionAll(d.select("doc_id", F.lit(False), "text"))
    return both.select("doc_id", "numbered", row_range(F.col("text")).alias("row_range"))


_ISLANDS = r"""(with l as (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos
    from (select doc_id, text || chr(10) || chr(10) || source || ',' || lang as t from documents)),
  g as (select *, sum(case when regexp_matches(line, '\S') then 0 else 1 end) over (partition by doc_id order by pos) as gap from l),
  k as (select * from g where regexp_matches(line, '\S'))
  select doc_id, dense_rank() over (partition by doc_id order by gap) - 1 as table_no, row_number() over (partition by doc_id, gap order by pos) - 1 as row_no, line from k)"""


def _islands(spark, sf):
    d = _texts(spark, sf).select("doc_id", F.concat("text", F.lit("\n\n"), "source", F.lit(","), "lang").alias("text"))
    return tables.islands(d, "doc_id")


@query(f"select * from {_ISLANDS}")
def csv_islands(spark, sf):
    return _islands(spark, sf).select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.col("row_no").cast("long").alias("row_no"), "line")


@query(
    f"""with c as (select doc_id, table_no, row_no, unnest(string_split(line, ',')) as v, unnest(range(len(string_split(line, ',')))) as col_no from {_ISLANDS}),
    n as (select doc_id, table_no, row_no, col_no, nullif(v, '') as value from c),
    f as (select doc_id, table_no, col_no from n group by all having count(value) > 0)
    select n.* from n join f using (doc_id, table_no, col_no)"""
)
def drop_null_cols(spark, sf):
    d = _texts(spark, sf).select("doc_id", F.concat("text", F.lit("\n\n"), "source", F.lit(","), "lang").alias("text"))
    return tables.filled_cells(d, "doc_id").select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("table_no", "row_no", "col_no")], "value")


@query(r"""select doc_id, source || ',' || case when regexp_matches(text, '[",\r\n]') then '"' || replace(text, '"', '""') || '"' else text end || ',' || coalesce(lang, '') as line from documents""")
def csv_render(spark, sf):
    cells = [tables.quoted(F.col(c)) for c in ("source", "text", "lang")]
    return _t(spark, sf, "documents").select("doc_id", F.concat_ws(",", *cells).alias("line"))


@query("select doc_id, n_chars || ': ' || to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) as line from documents")
def json_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tables.json_line(F.col("n_chars"), F.struct("doc_id", "lang", "source")).alias("line"))


@query("select doc_id, array_to_string([trim(source || ' '), '', trim(' ' || lang)], ' | ') as line from documents")
def cells_join(spark, sf):
    cells = F.array(F.concat("source", F.lit(" ")), F.lit(""), F.concat(F.lit(" "), F.col("lang")))
    return _t(spark, sf, "documents").select("doc_id", tables.joined_cells(cells).alias("line"))


@query(
    r"""with n as (select conv_id, 'Page ' || conv_id || ': ' || count(*) || ' image(s) detected' as note from conversations group by conv_id)
    select note, coalesce(try_cast(regexp_extract(note, 'Page\s+(\d+)', 1) as integer), -1)::bigint as page_num, 'figure_' || conv_id as table_id from n"""
)
def figure_notes(spark, sf):
    n = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    noted = n.select("conv_id", F.format_string("Page %d: %d image(s) detected", "conv_id", "n").alias("note"))
    return noted.select("note", figure_page(F.col("note")).cast("long").alias("page_num"), F.concat(F.lit("figure_"), F.col("conv_id").cast("string")).alias("table_id"))


_ROUTE = "case " + " ".join(f"when ext = '{k}' then '{v}'" for k, v in EXTRACTORS.items()) + " end"


@query(f"select doc_id, base, ext, {_ROUTE} as extractor from (select doc_id, {_BASE} as base, {_SUFFIX} as ext from {_OBJECTS})")
def route_ext(spark, sf):
    p = F.col("path")
    return _objects(spark, sf).select("doc_id", basename(p).alias("base"), extension(p).alias("ext"), extractor(p).alias("extractor"))


_ALLOWED = ", ".join(f"'{e}'" for e in ALLOWED_EXTENSIONS)


@query(f"select base as filename, 'docs' as bucket, ext || '/' || base as key, 'uploaded' as status from (select {_BASE} as base, {_SUFFIX} as ext from {_OBJECTS}) where ext in ({_ALLOWED})")
def bulk_upload_plan(spark, sf):
    return cdc.upload_plan(_objects(spark, sf), "docs", ALLOWED_EXTENSIONS)


@query(f"select doc_id, '/documents/minio/' || path as target from {_OBJECTS}")
def hdfs_paths(spark, sf):
    return _objects(spark, sf).select("doc_id", F.concat_ws("/", F.lit("/documents"), F.lit("minio"), "path").alias("target"))


@query(
    r"""with t as (select doc_id, text from documents union all select * from (values (-1, ''), (-2, '  '), (-3, chr(10) || chr(9)), (-4, null)) v(doc_id, text))
    select doc_id from t where regexp_matches(text, '\S')"""
)
def nonblank(spark, sf):
    blank = spark.createDataFrame([(-1, ""), (-2, "  "), (-3, "\n\t"), (-4, None)], "doc_id long, text string")
    return _t(spark, sf, "documents").select("doc_id", "text").unionAll(blank).where(~is_blank(F.col("text"))).select("doc_id")


@query(f"select path, octet_length(encode(text))::bigint as length from (select path, text from {_OBJECTS} union all select * from (values ('x/empty.txt', ''), ('x/_notes.txt', 'n')) v(path, text)) where text <> ''")
def nonempty_objects(spark, sf):
    more = spark.createDataFrame([("x/empty.txt", ""), ("x/_notes.txt", "n")], "path string, text string")
    rows = _objects(spark, sf).select("path", "text").unionAll(more)
    return rows.select("path", F.octet_length("text").cast("long").alias("length")).where("length > 0")


@query(f"select path from {_OBJECTS}")
def list_documents(spark, sf):
    keep = spark.createDataFrame([("pdf/.keep",), (".keep",)], "path string")
    return listing.documents_of(_objects(spark, sf).select("path").unionAll(keep))


@query("select source, count(*) as n, 4::bigint as pages from documents group by source order by source limit 5 offset 10")
def paginate(spark, sf):
    sources = _t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return listing.page(sources, 3, "source").withColumn("pages", F.lit(listing.total_pages(sources.count())).cast("long"))


@query(
    rf"""with l as (select path, regexp_replace(text, '(\r\n|\n|\r)$', '') as t from {_OBJECTS}), s as (select path, string_split_regex(t, '\r\n|\n|\r')[1:5] as l from l)
    select path, unnest(range(len(l))) as line_no, trim(unnest(l)) as line from s"""
)
def preview_lines(spark, sf):
    return listing.preview(_objects(spark, sf)).withColumn("line_no", F.col("line_no").cast("long"))


_STATE = f"(select path as file_path, case when source = 'src5' then 'old' else etag end as etag from {_OBJECTS} where source <> 'src3')"


def _state(spark, sf):
    o = _objects(spark, sf).where("source <> 'src3'")
    return o.select(F.col("path").alias("file_path"), F.when(F.col("source") == "src5", "old").otherwise(F.col("etag")).alias("etag"))


def _listing(spark, sf):
    return _objects(spark, sf).select(F.col("path").alias("file_path"), "etag")


_CHANGED = f"(select path as file_path, etag from {_OBJECTS} o where not exists (select 1 from {_STATE} s where s.file_path = o.path and s.etag = o.etag))"


@query(f"select * from {_CHANGED}")
def cdc_changed(spark, sf):
    return cdc.changed(_listing(spark, sf), _state(spark, sf))


@query(
    f"""select file_path, etag from (select *, 0 as gen from {_STATE} union all select *, 1 from {_CHANGED})
    qualify row_number() over (partition by file_path order by gen desc, etag desc) = 1"""
)
def cdc_state(spark, sf):
    return cdc.next_state(_state(spark, sf), cdc_changed(spark, sf))


@query(f"select file_path from {_STATE} where file_path not like 'src1/%' intersect select file_path from {_STATE} where file_path like 'src7/%'")
def cdc_deleted(spark, sf):
    now = _listing(spark, sf).where(~F.col("file_path").startswith("src7/"))
    return cdc.gone(now, _state(spark, sf))


_META = f"""(select path as object_key, case when source = 'src2' then 'v2' else etag end as etag, 'new' as seen, timestamp '2024-02-01' as ingested_at from {_OBJECTS} where source in ('src1', 'src2')
  union all select path, etag, 'known', timestamp '2024-01-01' from {_OBJECTS})"""


@query(f"select object_key, etag, seen from {_META} qualify row_number() over (partition by object_key, etag order by ingested_at desc) = 1")
def meta_upsert(spark, sf):
    o = _objects(spark, sf)
    row = lambda df, etag, seen, at: df.select(F.col("path").alias("object_key"), etag.alias("etag"), F.lit(seen).alias("seen"), F.lit(at).cast("timestamp").alias("ingested_at"))
    new = row(o.where(F.col("source").isin("src1", "src2")), F.when(F.col("source") == "src2", "v2").otherwise(F.col("etag")), "new", "2024-02-01")
    return cdc.upsert_metadata(row(o, F.col("etag"), "known", "2024-01-01"), new).select("object_key", "etag", "seen")


@query(f"select {_BASE} as filename from {_OBJECTS} where source <> 'src4'")
def upload_skip_existing(spark, sf):
    files = _objects(spark, sf).select(basename(F.col("path")).alias("filename"), "source")
    return cdc.skip_present(files.select("filename"), files.where("source = 'src4'"))


def _sets(spark, sf):
    d = _t(spark, sf, "documents")
    return d.where("lang = 'en'").select("source").distinct(), d.where("source in ('src1', 'src2', 'src21')").select("source").unionAll(spark.createDataFrame([("session",)], "source string"))


_A, _B = "select distinct source from documents where lang = 'en'", "(select source from documents where source in ('src1', 'src2', 'src21') union all select 'session')"


@query(f"{_A} union select source from {_B}")
def set_union(spark, sf):
    return listing.either(*_sets(spark, sf))


@query(f"{_A} intersect select source from {_B}")
def set_intersect(spark, sf):
    return listing.both(*_sets(spark, sf))


@query(f"{_A} except select source from {_B}")
def set_except(spark, sf):
    return listing.only_first(*_sets(spark, sf))


@query(f"select doc_id, sha256(source || '|' || coalesce(lang, '') || '|' || text) as point_id, to_json({{'text': text, 'source': source, 'lang': lang}}) as payload from {_POINTS}")
def points_payload(spark, sf):
    return payload(_points(spark, sf), ["source", "lang"]).select("doc_id", "point_id", "payload")


_SP = r"\s\p{Z}\x0b\x1c-\x1f\x85"


def _tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SP}]'))"


def _cut(level: int, parts: str) -> str:
    """One more level of the splitter: parts of more than 550 tokens are cut, the others stay."""
    return f"""l{level} as (select doc_id, list_append(pos, unnest(range(1, len(c) + 1))) as pos, unnest(c) as t
      from (select doc_id, pos, case when {_tokens("t")} <= 550 then [t] else list_filter({parts}, lambda x: x <> '') end as c from l{level - 1}))"""


_STRIP = rf"'^[{_SP}]+|[{_SP}]+$', '', 'g'"


@query(
    rf"""with recursive l0 as (select doc_id, cast([] as bigint[]) as pos, text as t from documents where text <> ''),
    {_cut(1, "string_split(replace(t, repeat(chr(10), 3), repeat(chr(10), 3) || chr(1)), chr(1))")},
    {_cut(2, rf"string_split(regexp_replace(t, '([.!?。？！])([{_SP}])', '\1' || chr(1) || '\2', 'g'), chr(1))")},
    {_cut(3, "regexp_extract_all(t, '[^,.;。？！]+[,.;。？！]?|[,.;。？！]')")},
    {_cut(4, rf"regexp_extract_all(t, '[^{_SP}]+[{_SP}]*|[{_SP}]+')")},
    {_cut(5, "string_split(t, '')")},
    parts as (select doc_id, row_number() over (partition by doc_id order by pos) as i, t, {_tokens("t")} as n from l5),
    merged as (
      select doc_id, i, [{{'t': t, 'n': n}}] as held, n as total, cast(null as varchar) as chunk from parts where i = 1
      union all
      select doc_id, i, list_append(kept, {{'t': t, 'n': n}}), coalesce(list_sum(list_transform(kept, lambda x: x.n)), 0) + n, chunk
      from (
        select p.doc_id, p.i, p.t, p.n,
          case when m.total + p.n <= 550 then m.held
            else list_transform(list_filter(range(1, len(m.held) + 1), lambda j: list_sum(list_transform(m.held[j:], lambda x: x.n)) <= least(100, 550 - p.n)), lambda j: m.held[j]) end as kept,
          case when m.total + p.n > 550 then array_to_string(list_transform(m.held, lambda x: x.t), '') end as chunk
        from merged m join parts p on p.doc_id = m.doc_id and p.i = m.i + 1)
    ),
    chunks as (
      select doc_id, i, regexp_replace(chunk, {_STRIP}) as text from merged where chunk is not null
      union all select doc_id, max(i) + 1, regexp_replace(array_to_string(list_transform(arg_max(held, i), lambda x: x.t), ''), {_STRIP}) from merged group by doc_id
    )
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_idx, count(*) over (partition by doc_id) as n_chunks, text from chunks where text <> ''"""
)
def sentence_chunks(spark, sf):
    """Sentence chunks of all documents."""
    rows = sentence_chunk_rows(_texts(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_idx", "n_chunks")], "text")


@query(
    r"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from documents where regexp_matches(text, '\S')),
    h as (select doc_id, ('0x' || left(md5(word), 8))::ubigint % 768 as place, case when ('0x' || substr(md5(word), 9, 1))::ubigint >= 8 then 1 else -1 end as sign from w),
    v as (select doc_id, place, sum(sign) as n from h group by all having sum(sign) <> 0)
    select d.doc_id, coalesce(list(cast(case when v.n > 0 then v.place + 1 else -v.place::integer - 1 end as integer) order by v.place) filter (v.place is not null), []) as signed_places,
      case when count(v.place) > 0 then 1.0::double else 0.0::double end as length
    from documents d left join v on d.doc_id = v.doc_id where regexp_matches(d.text, '\S') group by d.doc_id"""
)
def embed_hashed(spark, sf):
    """Hashed vectors of all documents: places from 1 that aren't 0, negative ones with their sign, and the length."""
    signed = F.array_compact(F.transform("embedding", lambda v, i: F.when(v > 0, i + 1).when(v < 0, -1 - i)))
    return embed(_texts(spark, sf).select("doc_id", "text")).select("doc_id", signed.alias("signed_places"), F.round(search.norm(F.col("embedding")), 4).alias("length"))


def _index(spark, sf, points: DataFrame, id: str) -> VectorIndex:
    return VectorIndex.build(points, scratch(spark), id=id)


@query(f"select doc_id, source, round(s, 6) as score, rank from {_top("source in ('src1', 'src2', 'src3')")}")
def topk_indexed(spark, sf):
    """One question against an index: all cells that can hold a hit, filtered before the limit."""
    index = _index(spark, sf, _points(spark, sf), "doc_id")
    hits = index.topk(_vector(spark, sf), search.ASK_K, probes=len(index.counts), rerank=RERANK, where="source in ('src1', 'src2', 'src3')")
    return _shown(hits)


@query(
    f"""with q as (select vec_id as question_id, embedding from embeddings where vec_id % 20 = 0),
    s as (select question_id, vec_id as id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as s from q, embeddings e)
    select question_id, id, round(s, 6) as score, row_number() over (partition by question_id order by s desc, id) as rank from s
    qualify row_number() over (partition by question_id order by s desc, id) <= {search.ASK_K}"""
)
def topk_bulk(spark, sf):
    """Many questions at once: the exact nearest points of every vector whose id is divisible by 20."""
    e = _t(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    found = _index(spark, sf, e, "vec_id").neighbours(asked, search.ASK_K, exact=True)
    return found.select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def index_recall(spark, sf):
    """What probing finds of those neighbours (recall of at least 0.95 is wanted), and the share of the points that it reads."""
    e = _t(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    index = _index(spark, sf, e, "vec_id")
    true = index.neighbours(asked, search.ASK_K, exact=True).select("question_id", "id")
    near = index.neighbours(asked, search.ASK_K).select("question_id", "id", F.lit(1).alias("hit"))
    return true.join(near, ["question_id", "id"], "left").agg(
        F.countDistinct("question_id").alias("questions"), (F.count("hit") / F.count("*")).alias("recall"), F.lit(index.probes).cast("long").alias("probes"), F.lit(len(index.counts)).cast("long").alias("cells"), F.lit(index.read_share()).alias("read_share")
    )


_OPEN, _CLOSE = sentences._OPENING.replace("'", "''"), sentences._CLOSING.replace("'", "''")


@query(
    rf"""with c as (select coalesce(lang, '') as lang, unnest(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'),
      lambda x: regexp_replace(regexp_replace(x, '^[{_OPEN}]+', ''), '[{_CLOSE},;:]+$', '')), lambda x: x <> '')) as core from documents),
    p as (select lang, core, lower(regexp_replace(core, '[.!?…]+$', '')) as plain from c),
    t as (select lang, case when regexp_full_match(plain, '{sentences._NUMBER}') then '{sentences.NUMBER}' else plain end as type, regexp_matches(core, '(^|[^.])\.$') as period from p),
    n as (select lang, type, count(*) as n, count(*) filter (period) as k from t where type <> '' group by all),
    a as (select lang, sum(k) / sum(n) as p from n group by lang),
    s as (select n.*, p, length(type) - length(replace(type, '.', '')) as inside from n join a using (lang) where k > 0),
    ll as (select *, -2 * (k * ln(greatest(p, 1e-12)) + (n - k) * ln(greatest(1 - p, 1e-12)) - k * ln(0.99) - (n - k) * ln(0.01)) as ll, length(type) - inside as size from s)
    select lang, type, n, k as n_period, case when regexp_matches(type, '\p{{L}}') then ll * exp(-size) * (inside + 1) * pow(greatest(size, 1)::double, -(n - k)) else 0 end >= {sentences.ABBREVIATION} as abbreviation,
      case when regexp_matches(type, '\p{{L}}') then round(ll * exp(-size) * (inside + 1) * pow(greatest(size, 1)::double, -(n - k)), 4) else 0 end + 0.0::double as score from ll"""
)
def boundary_types(spark, sf):
    """The words that stand with a period, and how much like an abbreviation each is, by language."""
    types = sentences.tables(_texts(spark, sf), by=F.col("lang"))["types"]
    return types.select("lang", "type", "n", "n_period", (F.col("score") >= sentences.ABBREVIATION).alias("abbreviation"), (F.round("score", 4) + F.lit(0.0)).alias("score"))  # no zero below zero


@query()
def sentences_learned(spark, sf):
    """Sentences of all documents, by the boundaries that they teach."""
    d = _texts(spark, sf).select("doc_id", "text", "lang")
    return sentences.sentences(d, sentences.learn(d, by=F.col("lang")), by=F.col("lang")).select("doc_id", "sentence_no", "text")
