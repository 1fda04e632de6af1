"""Sources: export files, sidecars, probe reports and catalogue payloads, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,bit_rate:string,sample_rate:string,channels:int>>,"
    "format struct<bit_rate:string,duration:string,tags:map<string,string>>"
)
LASTFM_TRACK = "track struct<listeners:string,playcount:string,duration:string,album:struct<title:string>,toptags:struct<tag:array<struct<name:string,count:int>>>>"
LASTFM_ARTIST = "artist struct<stats:struct<listeners:string,playcount:string>,tags:struct<tag:array<struct<name:string>>>,similar:struct<artist:array<struct<name:string>>>>"
RECORDINGS = (
    "recordings array<struct<id:string,title:string,score:int,isrcs:array<string>,releases:array<struct<title:string,date:string>>,tags:array<struct<name:string,count:int>>>>"
)
ARTISTS = "artists array<struct<id:string,country:string,disambiguation:string,`life-span`:struct<begin:string,end:string>>>"
LOOKUP = "results array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>,releases:array<struct<title:string>>>>>>"
SIDECAR = "metadata_id string, version int, created_at string, updated_at string, title string, artist string, hash_partial string"
#: Fields of an audio file and the tags that may hold them, first wins (fixed values).
TAG_KEYS = {
    "title": ["tit2", "title", "©nam"],
    "artist": ["tpe1", "artist", "©art"],
    "album": ["talb", "album", "©alb"],
    "year": ["tdrc", "tyer", "date", "year", "©day"],
    "track_number": ["trck", "tracknumber", "trkn"],
    "genre": ["tcon", "genre", "©gen"],
    "album_artist": ["tpe2", "albumartist", "aart"],
    "disc_number": ["tpos", "discnumber", "disk"],
    "total_tracks": ["tracktotal", "totaltracks", "trck_total", "trkn_total"],
    "original_year": ["tdor", "originaldate", "originalyear"],
    "label": ["tpub", "label", "organization"],
}
#: Ids that files hold, by the name of their source (fixed values).
ID_KEYS = {
    "musicbrainz": ["musicbrainz_trackid", "musicbrainz_recording_id"],
    "musicbrainz_artist": ["musicbrainz_artistid"],
    "musicbrainz_album": ["musicbrainz_albumid"],
    "embedded_isrc": ["isrc", "tsrc"],
}
#: Frames of a tag and what a probe calls them (fixed values).
FRAMES = {
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track", "TDRC": "date", "TYER": "year", "TCON": "genre", "TBPM": "bpm", "TKEY": "key", "TPUB": "publisher", "COMM": "comment", "TLAN": "language", "TCOP": "copyright",
    "TPE2": "album_artist", "TPOS": "disc_number",
}
SERVICE_TRACK = "tracks struct<items:array<struct<id:string,name:string,popularity:int,duration_ms:long,external_ids:struct<isrc:string>,album:struct<name:string,release_date:string>,artists:array<struct<id:string,name:string>>>>>"
AUDIO = ("mp3", "flac", "m4a", "ogg", "opus", "wav", "aac", "wma")


def read_export(spark: SparkSession, path: str, separator: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A delimited export with a header; every column stays text."""
    return spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', ignoreLeadingWhiteSpace=True, encoding=encoding, multiLine=False)


def separator_of(header: str) -> str:
    """Comma for quoted headers, else semicolon where there is one."""
    return "," if header.startswith('"') or '","' in header or ";" not in header else ";"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar documents; unreadable ones are left out."""
    rows = spark.read.schema(f"{SIDECAR}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.where("_corrupt_record is null and metadata_id is not null").drop("_corrupt_record")


#: Encodings that are tried in order; the last one reads anything.
ENCODINGS = ["utf-8", "utf-8-sig", "utf-16", "latin-1"]


def encoding_of(head: bytes) -> str:
    """The first encoding that reads the head of a file; a character cut at its end does not count against one."""
    import codecs

    for name in ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)().decode(head)
        except UnicodeError:
            continue
        return name
    return ENCODINGS[-1]


def sniff(spark: SparkSession, path: str, size: int = 65_536) -> tuple[str, str]:
    """(separator, encoding) of an export, from the head of its first file only."""
    head = spark.read.format("binaryFile").load(path).select(F.substr("content", F.lit(1), F.lit(size)).alias("h"), "path").where("length(h) > 0").orderBy("path").first()
    if head is None:
        raise FileNotFoundError(path)
    raw = bytes(head["h"])
    encoding = encoding_of(raw)
    text = raw.decode(encoding, "ignore")
    return separator_of(text.splitlines()[0] if text else ""), encoding


def scan_files(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, modificationTime, length) of audio files below a folder, but for excluded ones; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    found = files.where(F.lower(F.regexp_extract("path", r"\.([^.\\/]+)$", 1)).isin(*AUDIO))
    for name in excluded:
        found = found.where(~F.contains(F.lower("path"), F.lit("/" + name.strip("\\/").lower() + "/")))
    return found


def probe_report(text: Column) -> Column:
    """Technical fields of a probe's JSON: the first audio stream; the container's bit rate before the stream's."""
    doc = F.from_json(text, PROBE)
    audio = F.try_element_at(F.filter(doc["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1))
    return F.struct(
        audio["codec_name"].alias("codec"),
        F.coalesce(doc["format"]["bit_rate"].try_cast("long"), audio["bit_rate"].try_cast("long")).alias("bitrate"),
        audio["sample_rate"].try_cast("long").alias("sample_rate"),
        audio["channels"].cast("long").alias("channels"),
        (doc["format"]["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"),
        F.transform_keys(doc["format"]["tags"], lambda k, _: F.lower(k)).alias("tags"),
    )


def tag_field(tags: Column, field: str) -> Column:
    """The first filled tag of a field; numbers lose the total after ``/``, which stands for an absent total."""
    filled = lambda name: F.coalesce(*[F.nullif(F.trim(tags[k]), F.lit("")) for k in TAG_KEYS[name]])
    out = filled(field)
    if field == "total_tracks":
        return F.coalesce(out, F.try_element_at(F.split(filled("track_number"), "/", 2), F.lit(2)))
    return F.split(out, "/", 2)[0] if field.endswith("_number") else out


def file_tags(tags: Column) -> Column:
    """struct of all fields of a file's tags, its ids by source, and the tags as they are."""
    low = F.transform_keys(tags, lambda k, _: F.lower(k))
    ids = F.map_filter(F.create_map(*[x for name, keys in ID_KEYS.items() for x in (F.lit(name), F.coalesce(*[F.nullif(F.trim(low[k]), F.lit("")) for k in keys]))]), lambda _, v: v.isNotNull())
    return F.struct(*[tag_field(low, f).alias(f) for f in TAG_KEYS], ids.alias("embedded_ids"), F.to_json(tags).alias("raw_tags_json"))


def frame_tags(frames: Column) -> Column:
    """Known frames under their names; others and empty ones are left out."""
    names = F.create_map(*[x for k, v in FRAMES.items() for x in (F.lit(k), F.lit(v))])
    known = F.map_filter(frames, lambda k, v: names[k].isNotNull() & (F.trim(v) != ""))
    return F.transform_keys(known, lambda k, _: names[k])


def service_track(text: Column) -> Column:
    """The first hit of a service's track search: artists joined, the leading year of the release."""
    t = F.try_element_at(F.from_json(text, SERVICE_TRACK)["tracks"]["items"], F.lit(1))
    return F.struct(
        t["id"].alias("track_id"), t["name"].alias("title"), F.array_join(F.transform(t["artists"], lambda a: a["name"]), ", ").alias("artist"), t["album"]["name"].alias("album"),
        F.regexp_extract(t["album"]["release_date"], r"^(\d{4})", 1).alias("year"), t["external_ids"]["isrc"].alias("isrc"), t["duration_ms"].alias("duration_ms"), t["popularity"].alias("popularity"),
    )


def lastfm_track(text: Column) -> Column:
    t = F.from_json(text, LASTFM_TRACK)["track"]
    return F.struct(
        F.coalesce(t["listeners"].try_cast("long"), F.lit(0)).alias("listeners"),
        F.coalesce(t["playcount"].try_cast("long"), F.lit(0)).alias("play_count"),
        t["album"]["title"].alias("album"),
        F.coalesce(t["toptags"]["tag"], F.expr("cast(array() as array<struct<name:string,count:int>>)")).alias("tags"),
    )


def lastfm_artist(text: Column) -> Column:
    a = F.from_json(text, LASTFM_ARTIST)["artist"]
    return F.struct(
        F.coalesce(a["stats"]["listeners"].try_cast("long"), F.lit(0)).alias("listeners"),
        F.coalesce(a["stats"]["playcount"].try_cast("long"), F.lit(0)).alias("play_count"),
        a["tags"]["tag"]["name"].alias("tags"),
        a["similar"]["artist"]["name"].alias("similar_artists"),
    )


def recording(text: Column) -> Column:
    """The first hit of a recording search."""
    r = F.try_element_at(F.from_json(text, RECORDINGS)["recordings"], F.lit(1))
    release = F.try_element_at(r["releases"], F.lit(1))
    return F.struct(
        r["id"].alias("recording_id"), r["title"].alias("title"), F.try_element_at(r["isrcs"], F.lit(1)).alias("isrc"), release["title"].alias("album"), release["date"].alias("date")
    )


def artist(text: Column) -> Column:
    """The first hit of an artist search with its active years."""
    a = F.try_element_at(F.from_json(text, ARTISTS)["artists"], F.lit(1))
    span = a["life-span"]
    years = F.when(span["begin"].isNotNull(), F.concat(span["begin"], F.lit("-"), F.coalesce(span["end"], F.lit("present"))))
    return F.struct(a["id"].alias("artist_id"), a["country"].alias("country"), a["disambiguation"].alias("disambiguation"), years.alias("active_years"))


def fingerprint_hits(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row per (result, recording) of a fingerprint lookup, with the first artist and release."""
    r = rows.select(key, F.explode(F.from_json(text, LOOKUP)["results"]).alias("r")).select(key, "r.score", F.explode("r.recordings").alias("x"))
    return r.select(
        key,
        "score",
        F.col("x.id").alias("recording_id"),
        F.col("x.title").alias("title"),
        F.try_element_at("x.artists", F.lit(1))["name"].alias("artist"),
        F.try_element_at("x.releases", F.lit(1))["title"].alias("album"),
    )


def best_hit(hits: DataFrame, key: str) -> DataFrame:
    """The hit of the highest score of each lookup; ties go to the smallest recording."""
    order = F.struct((-F.col("score")).alias("s"), "recording_id")
    return hits.groupBy(key).agg(F.min_by(F.struct("score", "recording_id", "title", "artist", "album"), order).alias("b")).select(key, "b.*")
