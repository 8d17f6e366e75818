"""Addresses: three normal forms, notes and their tokens, shared texts, placeholders, images, covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# Hosts and paths of the two platforms, and the defaults of note addresses.
NOTE_HOSTS = ("xiaohongshu.com", "www.xiaohongshu.com")
SHORT_HOSTS = ("xhslink.com",)
POST_HOSTS = ("twitter.com", "www.twitter.com", "x.com", "www.x.com")
PLACEHOLDER_PATHS = ("/example/status/123456", "/i/web/status/123456")
NOTE_SOURCE = "pc_feed"
NOTE_BASE = "https://www.xiaohongshu.com/explore/"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(_part(url, "HOST"), F.lit("")))


def _query(url: Column, key: str) -> Column:
    return F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key))), F.lit(""))


def ingest_key(url: Column) -> Column:
    """As ingest compares addresses: up to the first '?', with any fragment."""
    return trim(F.substring_index(F.coalesce(url, F.lit("")), "?", 1))


def stripped(url: Column) -> Column:
    """Without query and fragment, the scheme and host in lower case, an empty path as '/'; '' for blank and '#'."""
    raw = trim(url)
    bare = F.regexp_replace(raw, r"(?s)[?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "")
    parsed = F.concat(head, F.when(rest == "", "/").otherwise(rest))
    return F.when(raw.isin("", "#"), "").when(raw.rlike(_SCHEME), parsed).otherwise(trim(F.substring_index(raw, "?", 1)))


def note(url: Column) -> Column:
    """(id, token, source) of a note's address; null id elsewhere."""
    raw = trim(url)
    found = F.regexp_extract(F.coalesce(_part(raw, "PATH"), F.lit("")), r"(?i)^/(?:discovery/item|explore)/([a-zA-Z0-9]+)", 1)
    ok = _host(raw).isin(*NOTE_HOSTS) & (found != "")
    source = trim(_query(raw, "xsec_source"))
    return F.struct(F.when(ok, found).alias("id"), F.when(ok, trim(_query(raw, "xsec_token"))).alias("token"), F.when(ok, F.when(source == "", NOTE_SOURCE).otherwise(source)).alias("source"))


def note_url(note_id: Column, token: Column, source: Column) -> Column:
    """A note's web address, with its token if there is one."""
    i, t, s = trim(note_id), trim(token), trim(source)
    encode = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    base = F.concat(F.lit(NOTE_BASE), encode(i))
    return F.when(i == "", "").when(t == "", base).otherwise(F.concat(base, F.lit("?xsec_token="), encode(t), F.lit("&xsec_source="), encode(F.when(s == "", NOTE_SOURCE).otherwise(s))))


def with_token(url: Column, token: Column, source: Column) -> Column:
    """A note's address with that token; other addresses as they are."""
    n = note(url)
    return F.when(n["id"].isNull(), trim(url)).otherwise(note_url(n["id"], token, source))


def library_url(url: Column) -> Column:
    """As the library compares addresses: notes keep their token, others lose query and fragment."""
    n = note(url)
    return F.when(n["id"].isNotNull(), note_url(n["id"], n["token"], n["source"])).otherwise(stripped(url))


def shared_link(text: Column) -> Column:
    """(platform, id, token) of the first address in a pasted text; null platform if it is of neither."""
    raw = trim(text)
    first = F.regexp_extract(raw, r"(?i)(https?://[^\s]+)", 1)
    url = F.when(first != "", first).when(raw == "", F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(_host(url), r"^www\.", "")
    path = F.coalesce(_part(url, "PATH"), F.lit(""))
    a_note = F.regexp_extract(path, r"(?i)/(?:explore|discovery/item)/([a-zA-Z0-9]+)", 1)
    a_post = F.regexp_extract(path, r"(?i)^/[^/]+/status/(\d+)", 1)
    is_note, is_short, is_post = host.isin("xiaohongshu.com") & (a_note != ""), host.isin(*SHORT_HOSTS), host.isin("twitter.com", "x.com") & (a_post != "")
    return F.struct(
        F.when(is_note | is_short, "notes").when(is_post, "microblog").alias("platform"), F.when(is_note, a_note).when(is_post, a_post).alias("id"),
        F.when(is_note, F.nullif(_query(url, "xsec_token"), F.lit(""))).alias("token"),
    )


def is_placeholder_url(url: Column) -> Column:
    """Sample posts' addresses; '#' and blank aren't among them."""
    raw = trim(url)
    parsed = _host(raw).isin(*POST_HOSTS) & F.lower(F.coalesce(_part(raw, "PATH"), F.lit(""))).isin(*PLACEHOLDER_PATHS)
    return F.when(raw.isin("", "#"), False).when(raw.rlike(_SCHEME), parsed).otherwise(F.lower(raw).rlike(r"(twitter|x)\.com/example/status/123456"))


def openable_url(url: Column) -> Column:
    raw = trim(url)
    return F.when(raw.isin("", "#") | is_placeholder_url(url), "").otherwise(raw)


def block_reason(url: Column) -> Column:
    """Why an address can't be opened: 'missing', 'placeholder' or ''."""
    return F.when(trim(url).isin("", "#"), "missing").when(is_placeholder_url(url), "placeholder").otherwise("")


# Cover pools and their paths.
POOL = 10
_OLD, _NEW = r"(?i)/fallback-covers/cover-(\d{1,3})\.svg(?:\?|#|$)", r"(?i)/dashboard-fallbacks/nature-(\d{1,2})\.svg(?:\?|#|$)"
_SEMANTIC = r"(?i)/dashboard-fallbacks/semantic-(?:image-gen|video-gen|vibe-coding)\.svg(?:\?|#|$)"
SEMANTIC_COVERS = {"Image Gen": "/dashboard-fallbacks/semantic-image-gen.svg", "Video Gen": "/dashboard-fallbacks/semantic-video-gen.svg", "Vibe Coding": "/dashboard-fallbacks/semantic-vibe-coding.svg"}


def cover_path(index: Column) -> Column:
    """The pool's cover of a number, which wraps into 1..POOL; 1 for what is no positive number."""
    n = F.when(F.coalesce(index, F.lit(0)) > 0, F.pmod(index - 1, F.lit(POOL)) + 1).otherwise(1)
    return F.concat(F.lit("/dashboard-fallbacks/nature-"), F.lpad(n.cast("string"), 2, "0"), F.lit(".svg"))


def is_fallback_cover(url: Column) -> Column:
    raw = trim(url)
    return raw.rlike(_OLD) | raw.rlike(_NEW) | raw.rlike(_SEMANTIC)


def normal_cover(url: Column) -> Column:
    """Fallback covers of either pool by their new path; others as they are."""
    raw = trim(url)
    number = lambda p: F.regexp_extract(raw, p, 1).try_cast("int")
    return F.when(raw.rlike(_OLD), cover_path(number(_OLD))).when(raw.rlike(_NEW), cover_path(number(_NEW))).otherwise(raw)


def seed_hash(seed: Column) -> Column:
    """The magnitude of the 32-bit hash h = 31 h + unit over the UTF-16 units of a seed."""
    units = F.encode(F.coalesce(seed, F.lit("")), "UTF-16BE")
    n = (F.octet_length(units) / 2).cast("int")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, 2)), 16, 10).cast("long")
    wrap = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.when(h.bitwiseAND(F.lit(0x80000000)) != 0, F.lit(1 << 32)).otherwise(F.lit(0))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.abs(F.aggregate(every, F.lit(0).cast("long"), lambda h, i: wrap(h * 31 + unit(i))))


def seeded_cover(seed: Column) -> Column:
    return cover_path(seed_hash(seed) % POOL + 1)


def is_renderable(url: Column) -> Column:
    v = trim(url)
    return v.rlike(r"(?i)^https?://") | v.startswith("/") | v.startswith("data:image/") | v.startswith("blob:")


def is_placeholder_image(url: Column) -> Column:
    """Blank, or one of the platform's default images; fallback covers aren't."""
    v = F.lower(trim(url))
    default = v.contains("abs.twimg.com") | v.contains("default_profile") | v.contains("placeholder")
    return F.when(v == "", True).when(is_fallback_cover(url), False).otherwise(default)


def analyzable_images(urls: Column) -> Column:
    """Distinct web images that aren't fallback covers or made by the image service."""
    def wanted(u: Column) -> Column:
        v = F.lower(u)
        made = v.contains("dashscope") | v.contains("bailian") | (v.contains("aliyuncs.com") & (v.contains("generated") | v.contains("aigc")))
        return u.rlike(r"(?i)^https?://") & ~is_fallback_cover(u) & ~made

    return F.array_distinct(F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), trim), wanted))


def choose_cover(cover: Column, images: Column, category: Column) -> Column:
    """The cover, else the first image that is no placeholder, else the category's fixed one."""
    usable = lambda u: ~is_placeholder_image(u)
    own = F.when(usable(cover), normal_cover(cover))
    first = F.get(F.filter(F.coalesce(images, F.array().cast("array<string>")), usable), F.lit(0))
    fixed = F.create_map(*[F.lit(x) for kv in SEMANTIC_COVERS.items() for x in kv])
    return F.coalesce(own, F.when(first.isNotNull(), normal_cover(first)), fixed[F.when(category == "", "Vibe Coding").otherwise(category)])


# How a note's image is addressed by its file id, and the formats that addresses are asked for.
NOTE_IMAGE = ("https://sns-img-bd.xhscdn.com/", "?imageView2/2/w/660/format/jpg/q/75")
HEIF, JPG = "format/heif", "format/jpg"


def as_jpg(url: Column) -> Column:
    """The address of the same image in a format that all can show; '' for null."""
    return F.replace(F.coalesce(url, F.lit("")), F.lit(HEIF), F.lit(JPG))


def note_image(file_id: Column, *urls: Column) -> Column:
    """An image's address: by its file id if it has one, else the first address that isn't blank."""
    by_id = F.concat(F.lit(NOTE_IMAGE[0]), file_id, F.lit(NOTE_IMAGE[1]))
    first = F.coalesce(*[F.nullif(u, F.lit("")) for u in urls])
    return F.when(F.coalesce(file_id, F.lit("")) != "", by_id).otherwise(as_jpg(first))


def note_cover(cover: Column, images: Column, index: Column) -> Column:
    """A note's cover: its own (an address, or JSON with a file id or addresses), else the image of that number, else the first.

    images: addresses by note_image(), in order.
    """
    part = lambda key: F.get_json_object(cover, f"$.{key}")
    json = F.coalesce(cover.startswith("{"), F.lit(False))
    own = F.when(json, note_image(part("fileid"), *map(part, ("url_size_large", "url", "url_default", "url_pre", "url_original")))).otherwise(as_jpg(cover))
    number = F.coalesce(index.try_cast("double").try_cast("int"), F.lit(0))
    numbered = F.when(number >= 0, F.get(images, number))
    return F.coalesce(F.nullif(own, F.lit("")), numbered, F.get(images, F.lit(0)), F.lit(""))
