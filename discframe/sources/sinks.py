"""Text sinks: scan logs, manifests, subtitles, index files, chapters and tags.

A document is a set of ordered lines (``line_no`` per document), so writing never
gathers a whole document in one value: sort by document and line and write as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discframe.functions import clock, lang
from discframe.functions.text import quote_log
from discframe.operators import ordered as o

TYPE_NAMES = {"video": "Video", "audio": "Audio", "subtitle": "Subtitle"}


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    ranked = o.ordered(rows, group, order, block_on=order[:2], _rn=o.row_number())
    return ranked.select(group, (F.col("_rn") - 1).alias("line_no"), "line")


def write_lines(lines: DataFrame, group: str, path: str) -> None:
    """One folder per document; lines keep their order across the part files."""
    spread = lines.repartitionByRange(group, "line_no").sortWithinPartitions(group, "line_no")
    spread.select(group, "line").write.partitionBy(group).text(path)


def scan_log(titles: DataFrame, streams: DataFrame, bluray: bool = True) -> DataFrame:
    """Robot-format scan log per disc: ``disc_id, line_no, line``.

    Titles: ``disc_id, title_id, title_idx, n_chapters, duration, bytes, source,
    segment_map, disc_name``; titles without streams are left out.
    """
    listed = titles.join(streams.select("title_id").distinct(), "title_id", "left_semi")
    at = F.col("title_idx").cast("string")

    def row(section: int, sub: Column, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), sub.cast("long").alias("sub"), line.alias("line"))

    heads = listed.groupBy("disc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("disc_name", F.when(F.col("disc_name") != "", F.col("title_idx"))).alias("name"),
    )
    medium = "Blu-ray disc" if bluray else "DVD disc"
    head_lines = F.array_compact(
        F.array(
            row(0, F.lit(0), F.concat(F.lit("CINFO:1,0,"), quote_log(F.lit(medium)))),
            F.when(F.col("name").isNotNull(), row(0, F.lit(1), F.concat(F.lit("CINFO:2,0,"), quote_log(F.col("name"))))),
            row(0, F.lit(2), F.concat(F.lit("TCOUNT:"), F.col("n").cast("string"))),
        )
    )
    top = heads.select("disc_id", F.lit(-1).alias("title_idx"), F.explode(head_lines).alias("l"))
    size = F.format_string("%.1f GB", F.col("bytes") / 1_000_000_000)
    fields = [
        (8, F.col("n_chapters").cast("string")),
        (9, clock.fmt_duration(F.col("duration"))),
        (10, size),
        (11, F.greatest("bytes", F.lit(0)).cast("string")),
        (16 if bluray else 24, F.col("source")),
    ]
    if bluray:
        fields.append((26, F.col("segment_map")))
    infos = F.array(
        *[
            row(1, F.lit(i), F.concat(F.lit("TINFO:"), at, F.lit(f",{code},0,"), quote_log(value)))
            for i, (code, value) in enumerate(fields)
        ]
    )
    middle = listed.select("disc_id", "title_idx", F.explode(infos).alias("l"))
    numbered = o.ordered(streams, "title_id", ["pos"], _rn=o.row_number()).join(
        listed.select("disc_id", "title_id", "title_idx"), "title_id"
    )
    prefix = F.concat(F.lit("SINFO:"), at, F.lit(","), (F.col("_rn") - 1).cast("string"), F.lit(","))

    def info(code: int, value: Column) -> Column:
        return F.concat(prefix, F.lit(f"{code},0,"), quote_log(value))

    audio, video = F.col("type") == "audio", F.col("type") == "video"
    size_text = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    spoken = ~video
    sub = F.col("_rn") * 10
    track_lines = F.array_compact(
        F.array(
            row(2, sub, info(1, lang.lookup(TYPE_NAMES, F.col("type"), F.lit("")))),
            F.when(F.col("codec") != "", row(2, sub + 1, info(7, F.col("codec")))),
            F.when(audio & (F.col("codec") != ""), row(2, sub + 2, info(2, F.col("codec")))),
            F.when(spoken, row(2, sub + 3, info(3, F.col("lang")))),
            F.when(spoken, row(2, sub + 4, info(4, F.col("lang")))),
            F.when(video & size_text.isNotNull(), row(2, sub + 5, info(19, size_text))),
        )
    )
    bottom = numbered.select("disc_id", "title_idx", F.explode(track_lines).alias("l"))
    every = top.unionByName(middle).unionByName(bottom).select("disc_id", "title_idx", "l.*")
    return _numbered(every, "disc_id", ["title_idx", "section", "sub"])


def disc_manifest(titles: DataFrame, streams: DataFrame) -> DataFrame:
    """JSON manifest per disc as ordered lines: an object with one title per line.

    Concatenated, the lines of a disc are one JSON document; a title's streams are one
    line each as well, so no line grows with the data.  Unknown values are JSON nulls.
    """
    named = o.ordered(streams, "title_id", ["pos"], _rn=o.row_number())
    per_title = o.with_group(
        named.join(titles.select("disc_id", "title_id", "title_idx"), "title_id"), "title_id", _n=F.max("_rn")
    )
    last = o.with_group(titles, "disc_id", _last=F.max("title_idx"))
    body = F.to_json(
        F.struct(
            F.col("title_idx").alias("index"),
            "name",
            F.bround("duration", 3).alias("duration_seconds"),
            F.col("bytes").alias("size_bytes"),
            F.col("n_chapters").alias("chapters"),
            F.col("source").alias("source_file"),
            "segment_map",
            "dvd_title_id",
        ),
        {"ignoreNullFields": "false"},
    )
    # The title object stays open for its streams: drop the closing brace.
    opened = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"streams":['))
    more = F.when(F.col("title_idx") < F.col("_last"), ",").otherwise("")
    track = F.to_json(
        F.struct((F.col("_rn") - 1).alias("index"), "type", "codec", F.col("lang").alias("language"), "title"),
        {"ignoreNullFields": "false"},
    )
    comma = F.when(F.col("_rn") < F.col("_n"), ",").otherwise("")

    def rows(df: DataFrame, section: int, sub: Column, line: Column) -> DataFrame:
        return df.select("disc_id", "title_idx", F.lit(section).alias("section"), sub.cast("long").alias("sub"), line.alias("line"))

    zero = F.lit(0)
    discs = last.groupBy("disc_id").agg(F.max("title_idx").alias("_last"))
    head = discs.select("disc_id", F.lit(-1).alias("title_idx"))
    tail = discs.select("disc_id", (F.col("_last") + 1).alias("title_idx"))
    every = (
        rows(head, 0, zero, F.lit('{"schema_version":1,"titles":['))
        .unionByName(rows(last, 1, zero, opened))
        .unionByName(rows(per_title, 2, F.col("_rn"), F.concat(track, comma)))
        .unionByName(rows(last, 3, zero, F.concat(F.lit("]}"), more)))
        .unionByName(rows(tail, 4, zero, F.lit("]}")))
    )
    return _numbered(every, "disc_id", ["title_idx", "section", "sub"])


def to_srt(cues: DataFrame, key: str = "stream_id", text: str = "text", offset: Column | int = 0) -> DataFrame:
    """SubRip blocks: ``key, cue, block`` with 1-based cue numbers.

    Cues: ``key, cue, start, end, text`` in ticks.
    """
    shift = F.lit(offset) if isinstance(offset, int) else offset
    times = F.concat(
        clock.fmt_srt(F.greatest(F.col("start") - shift, F.lit(0))),
        F.lit(" --> "),
        clock.fmt_srt(F.greatest(F.col("end") - shift, F.lit(0))),
    )
    block = F.concat_ws("\n", F.col("cue").cast("string"), times, F.col(text), F.lit(""))
    return cues.select(key, "cue", block.alias("block"))


def to_ass(cues: DataFrame, width: int = 720, height: int = 480, key: str = "stream_id", rows: int = 15, columns: int = 32) -> DataFrame:
    """ASS dialogue lines placing each grid line on the frame.

    Cues: ``key, cue, start, end, row, column, text``.
    """
    x = F.bround(F.col("column") * width / columns).cast("int")
    y = F.bround((F.col("row") + 0.8) * height / rows).cast("int")
    line = F.concat(
        F.lit("Dialogue: 0,"), clock.fmt_ass(F.col("start")), F.lit(","), clock.fmt_ass(F.col("end")),
        F.lit(",CC,,0,0,0,,{\\pos("), x.cast("string"), F.lit(","), y.cast("string"), F.lit(")}"), F.col("text"),
    )
    return cues.select(key, "cue", "row", line.alias("line"))


def vobsub_index(events: DataFrame, key: str = "stream_id", offset: Column | int = 0) -> DataFrame:
    """Index lines per subtitle track after interleaving all tracks by time.

    Events: ``key, sub_id, pts, seq, size`` (packed bytes); ``filepos`` is the running
    byte offset over the file's events in time order.
    """
    shift = F.lit(offset) if isinstance(offset, int) else offset
    placed = o.ordered(events, key, ["pts", "sub_id", "seq"], _at=o.sum_before("size"))
    line = F.concat(
        F.lit("timestamp: "),
        clock.fmt_idx(F.col("pts") - shift),
        F.lit(", filepos: "),
        F.lpad(F.lower(F.hex(F.col("_at").cast("long"))), 9, "0"),
    )
    ranked = o.ordered(placed, [key, "sub_id"], ["pts", "_at"], _rn=o.row_number())
    return ranked.select(key, "sub_id", (F.col("_rn") - 1).alias("line_no"), line.alias("line"))


def chapters_xml(atoms: DataFrame, language: str = "eng", group: str = "group_id") -> DataFrame:
    """Ordered-chapter XML per group as lines, one atom element per line.

    Atoms: ``group, edition, atom_idx, start, end, hidden, name``; the first edition is
    the default one, atom ids count through all editions from 1001.
    """
    order = ["edition", "atom_idx"]
    own = F.struct("edition")
    placed = o.ordered(
        atoms, group, order, block_on=order, _uid=o.row_number(), _before=o.lag(own), _after=o.lead(own)
    ).withColumns(
        {
            "_opens": F.coalesce(~F.col("_before").eqNullSafe(own), F.lit(True)),
            "_closes": F.coalesce(~F.col("_after").eqNullSafe(own), F.lit(True)),
        }
    )
    counted = o.ordered(
        placed.withColumn("_one", F.col("_opens").cast("long")), group, order, block_on=order, _editions=o.sum_to("_one")
    )
    first = o.with_group(counted, group, _first=F.min("edition"), _final=F.max("edition"))
    display = F.when(
        F.col("hidden"), F.lit("")
    ).otherwise(
        F.concat(
            F.lit("<ChapterDisplay><ChapterString>"), _escape(F.coalesce("name", F.lit(""))),
            F.lit(f"</ChapterString><ChapterLanguage>{language}</ChapterLanguage></ChapterDisplay>"),
        )
    )
    element = F.concat(
        F.lit("<ChapterAtom><ChapterUID>"), (F.col("_uid") + 1000).cast("string"),
        F.lit("</ChapterUID><ChapterTimeStart>"), clock.fmt_ns(F.col("start")),
        F.lit("</ChapterTimeStart><ChapterTimeEnd>"), clock.fmt_ns(F.col("end")),
        F.lit("</ChapterTimeEnd><ChapterFlagHidden>"), F.col("hidden").cast("int").cast("string"),
        F.lit("</ChapterFlagHidden><ChapterFlagEnabled>1</ChapterFlagEnabled>"), display, F.lit("</ChapterAtom>"),
    )
    opening = F.concat(
        F.when(F.col("edition") == F.col("_first"), "<Chapters>").otherwise(""),
        F.lit("<EditionEntry><EditionUID>"), (F.col("edition") + 1).cast("string"),
        F.lit("</EditionUID><EditionFlagHidden>0</EditionFlagHidden><EditionFlagDefault>"),
        (F.col("edition") == F.col("_first")).cast("int").cast("string"),
        F.lit("</EditionFlagDefault><EditionFlagOrdered>1</EditionFlagOrdered>"),
    )
    closing = F.concat(F.lit("</EditionEntry>"), F.when(F.col("edition") == F.col("_final"), "</Chapters>").otherwise(""))
    # Lines before an atom: the atoms before it, the heads up to its own and the tails of other editions.
    at = (F.col("_uid") + 2 * F.col("_editions") - 2).cast("int")

    def row(line_no: Column, line: Column) -> Column:
        return F.struct(line_no.alias("line_no"), line.alias("line"))

    lines = F.array_compact(
        F.array(F.when(F.col("_opens"), row(at - 1, opening)), row(at, element), F.when(F.col("_closes"), row(at + 1, closing)))
    )
    return first.select(group, F.explode(lines).alias("l")).select(group, "l.*")


def _escape(value: Column) -> Column:
    text = F.replace(value, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def tag_pairs(df: DataFrame, ident: str, tags: list[tuple[str, Column]]) -> DataFrame:
    """``ident, tag_no, name, value`` for the tags of a row that have a value."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("tag_no"), F.lit(name).alias("name"), value.cast("string").alias("value")) for i, (name, value) in enumerate(tags)]
    )
    rows = df.select(ident, F.explode(entries).alias("t")).select(ident, "t.*")
    return rows.filter(F.coalesce("value", F.lit("")) != "")
