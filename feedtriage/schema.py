"""Fixed schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("page_ord", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

# One fetched item. The order columns define the processing order; ``seq`` is
# their dense rank, added by ``operators.numbering.dense_index`` when needed.
ARTICLE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("published", T.TimestampType()),
])

ORDER_COLUMNS = ["source_ord", "fetched_at", "page_ord", "entry_ord"]

CLASSIFICATION = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("canonical_key", T.StringType()),
    T.StructField("one_line", T.StringType()),
    T.StructField("is_zero_or_nday", T.BooleanType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("vuln_class", T.StringType()),
    T.StructField("affected_component", T.StringType()),
    T.StructField("cve_ids", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("relevance", T.IntegerType()),
])

SEEN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("vuln_class", T.StringType()),
    T.StructField("canonical_key", T.StringType()),
    T.StructField("cve_ids", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("first_seen_at", T.TimestampType()),
])

SOURCES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("bypass_prefilter", T.BooleanType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source_ord", T.IntegerType()),
])

DECISION = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("matched_record_id", T.LongType()),
])

KEV_PAYLOAD = (
    "struct<count:int, vulnerabilities:array<struct<cveID:string, vendorProject:string,"
    " product:string, vulnerabilityName:string, dateAdded:string, shortDescription:string,"
    " requiredAction:string, knownRansomwareCampaignUse:string>>>"
)

ADVISORY_PAGE = (
    "array<struct<ghsa_id:string, cve_id:string, summary:string, description:string,"
    " severity:string, html_url:string, published_at:string,"
    " vulnerabilities:array<struct<package:struct<ecosystem:string, name:string>>>>>"
)

FEED_ENTRY = (
    "struct<title:string, link:array<struct<_VALUE:string,_href:string,_rel:string>>,"
    " guid:struct<_VALUE:string,_isPermaLink:string>, description:string, summary:string,"
    " content:string, encoded:string, pubDate:string, published:string, issued:string,"
    " updated:string, modified:string, date:string>"
)
# RSS 2.0 keeps items in the channel, RDF beside it, Atom calls them entries.
FEED_PAYLOAD = (
    f"struct<channel:struct<item:array<{FEED_ENTRY}>>,"
    f" item:array<{FEED_ENTRY}>, entry:array<{FEED_ENTRY}>>"
)
