"""License scans by diagonal voting, with DataFrame functions only.

All rolling word 3-grams of a document are hashed and joined to the templates' 3-grams. A match votes for its
template and diagonal (its place in the document less its place in the template). Votes are summed by diagonal,
neighbouring diagonals (words inserted or left out) are merged, and a merged span is verified: its 3-grams are equal
by their words, not only their hashes, it covers enough of the template, and it is about as long.

The templates are fixed and few, so their hashes stand in the scan as a set and their rows are broadcast. Only votes
leave the scan; whole texts are never shuffled.

Defined cases: a null text is empty; a document without words has no label and score 0; very long texts are scanned
whole; repeated rows are scanned each for itself; an empty table gives no rows; extra columns are ignored whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K = 3
#: Diagonals at most so far apart belong to one span; a span covers at least this share of its template's 3-grams
#: and is at most so many times as long.
SLACK = 4
MIN_COVER = 0.6
MAX_STRETCH = 1.5

#: Phrases that count wherever their words stand consecutively, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of public licence texts, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
}


def template_rows() -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, base, 3-grams, place, 3-gram) of every template."""
    out = []
    for t, (phrase, label, base) in enumerate([(p, v, True) for p, v in BASE.items()] + [(p, v, False) for p, v in TEMPLATES.items()]):
        ws = phrase.split()
        out += [(t, label, base, len(ws) - K + 1, i, " ".join(ws[i : i + K])) for i in range(len(ws) - K + 1)]
    return out


def votes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with rid, doc_id, n_words and matches; votes joined to templates)."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(template_rows(), "template int, label string, base boolean, m int, tpos int, gram string")
    parts = F.split("gram", " ")
    rows = rows.withColumn("h", F.xxhash64(*(parts[i] for i in range(K))))
    wanted = [r["h"] for r in rows.select("h").distinct().collect()]  # of the fixed templates alone
    words = F.regexp_extract_all(C.lowered(F.col("text")), F.lit(f"({C.WORD_PATTERN})"), F.lit(1))
    scanned = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words.alias("words"))
    hashed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *(F.get("words", i + k) for k in range(1, K))).alias("h")))
    found = F.filter(hashed, lambda x: x["h"].isin(wanted))
    matches = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.array_join(F.slice("words", x["pos"] + 1, K), " ").alias("gram")))
    scanned = C.materialise(scanned.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches")), "licenses")
    each = scanned.select("rid", F.explode("matches").alias("x")).select("rid", "x.*")
    return scanned, each.join(F.broadcast(rows), ["h", "gram"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places (n_base, first_word, last_word, base_labels), labels, score, and spans (label,
    first and end word, coverage) of every document."""
    scanned, voted = votes(docs)
    by = voted.groupBy("rid", "template", "label", "base", "m", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("end"))
    by = by.withColumn("end", F.col("end") + K)
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= SLACK, 0).otherwise(1)
    spans = by.filter(~F.col("base")).withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(along))
    spans = spans.groupBy("rid", "template", "label", "m", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("first").alias("first"), F.max("end").alias("end"))
    spans = spans.withColumn("cover", F.col("n") / F.col("m"))
    spans = spans.filter((F.col("cover") >= MIN_COVER) & (F.col("end") - F.col("first") <= MAX_STRETCH * (F.col("m") + K - 1)))
    verified = spans.select("rid", "label", F.lit(False).alias("base"), "first", "end", "cover")
    exact = by.filter(F.col("base") & (F.size("at") == F.col("m"))).select("rid", "label", "base", "first", "end", F.lit(1.0).alias("cover"))
    place = F.when(F.col("base"), F.col("first"))
    per = exact.unionByName(verified).groupBy("rid").agg(
        F.count(place).alias("n_base"), F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"), F.sort_array(F.collect_list(F.struct("first", "end", "label", "cover"))).alias("spans"),
    )
    empty = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return scanned.select("rid", "doc_id", "n_words").join(per, "rid", "left").fillna(empty).drop("rid")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_ROWS = ", ".join(f"({t}, '{label}', {str(base).lower()}, {m}, {i}, '{g}')" for t, label, base, m, i, g in template_rows())
OP5_SQL = f"""
WITH tpl(template, label, base, m, tpos, gram) AS (VALUES {_ROWS}),
     d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '{C.WORD_PATTERN}') AS w FROM documents),
     g AS (SELECT rid, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
     v AS (SELECT rid, template, label, base, m, tpos, pos, pos - tpos AS diagonal FROM g JOIN tpl USING (gram)),
     b AS (SELECT rid, template, label, base, m, diagonal, list(DISTINCT tpos) AS places, min(pos) AS f, max(pos) + {K} AS e FROM v GROUP BY ALL),
     s1 AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS fresh FROM b WHERE NOT base),
     s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM s1),
     s3 AS (SELECT rid, template, label, m, span, len(list_distinct(flatten(list(places)))) / CAST(m AS DOUBLE) AS cover, min(f) AS f, max(e) AS e FROM s2 GROUP BY rid, template, label, m, span),
     s AS (SELECT rid, label, false AS base, f, cover FROM s3 WHERE cover >= {MIN_COVER} AND e - f <= {MAX_STRETCH} * (m + {K - 1})
           UNION ALL SELECT rid, label, true, f, 1.0 FROM b WHERE base AND len(places) = m),
     p AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(f) FILTER (WHERE base) AS first_word, max(f) FILTER (WHERE base) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
           FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN p USING (rid)
"""
