"""License scan by a positional index of rare words.

The index has, for each word that stands once in a licence text, the texts that
hold it with its place. The corpus decides how rare these words are. A file
looks up, for each licence text, its own words of highest IDF among the text's,
`anchors` of them; each occurrence votes for the place at which the text would
begin, and the votes are intersected by relative position: the share of the
anchors that agree on one beginning is its score. A label is given where any
beginning has a share that reaches `least` and every mandatory key phrase of the
text stands, whole, within the stretch that the text would cover, give or take
`slack` words; the score is the largest share of such beginnings. Words that a
file changed, left out or put in move votes, or lose some, but not all.
Base phrases are labelled wherever their words stand consecutively.

Cases: a null or empty text has no words and no label, score 0; words are runs
of characters other than ASCII punctuation, space and controls, compared with
A-Z lower-cased; all beginnings that reach `least` are verified; an empty table
gives an empty result; repeated rows are scanned alike; other columns are not looked at.
The licence texts, and so the index, have a fixed size, whatever the corpus.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, PUNCT_ANYCASE, table

#: Phrases whose words alone decide a label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed values: (label, text of the licence or of the notice it prescribes, mandatory key phrases).
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "with the distribution this software is provided by"),
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ("redistribution and use in source and binary forms", "nor the names of its contributors may be used to endorse or promote products"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2", "in compliance with the license"),
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("terms of the gnu general public license", "version 2 of the license"),
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("terms of the gnu general public license", "version 3 of the license"),
    ),
    (
        "lgpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ("terms of the gnu lesser general public license", "version 3 of the license"),
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        ("terms of the gnu affero general public license", "version 3 of the license"),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license v 2 0",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ("including commercial applications and to alter it and redistribute it freely",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain",),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international",),
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc0",
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        ("associated cc0 with this work",),
    ),
)


def _lower(text: Column) -> Column:
    # the Kelvin sign is the one other character whose lower case has an ASCII letter of the phrases alone
    return F.lower(F.regexp_replace(text, "\u212a", "\u00e7"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), PUNCT), "")


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """In how many documents each licence word stands; at most as many rows as the templates have words."""
    vocab = F.array(*map(F.lit, vocabulary()))
    rows = docs.select(F.explode(F.array_intersect(words(F.col("text")), vocab)).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def build_index(df: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each template its words with their places, the rarest in the corpus first. Words that a template repeats have no one place and are left out."""
    out = []
    for _, text, _ in TEMPLATES:
        ws = text.split()
        once = [(df.get(w, 0), w, i) for i, w in enumerate(ws) if ws.count(w) == 1]
        out.append([(w, i) for _, w, i in sorted(once)])
    return out


def _places(ws: Column, phrase: str) -> Column:
    """Word places, from 0, where the phrase's words stand consecutively."""
    want = phrase.split()
    hit = lambda w, i: reduce(lambda a, b: a & b, [w == want[0]] + [F.get("__w", i + k) == x for k, x in enumerate(want) if k])
    at = F.transform(ws, lambda w, i: F.when(F.coalesce(hit(w, i), F.lit(False)), i))
    return F.array_compact(at)


def _bind(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _score(t: Column, words: Column, hits: Column, have: Column, anchors: int, least: float, slack: int) -> Column:
    """The largest share of a template's anchors that agree on a beginning whose stretch holds all its key phrases; null if none reaches least.

    t: struct of words (rarest first), at (their places), n (its length), keys. hits: the file's licence words, w at i; have: the distinct ones.
    """
    size = F.least(F.lit(anchors), F.size(t["words"]))
    chosen = F.slice(F.filter(t["words"], lambda w: F.array_contains(have, w)), 1, anchors)
    vote = lambda x: x["i"] - F.element_at(t["at"], F.array_position(t["words"], x["w"]).cast("int"))

    def near(at: Column, phrase: Column) -> Column:
        # words hold no space, so a phrase between spaces is whole words
        start = F.greatest(at - slack, F.lit(0))
        piece = F.slice(words, start + 1, F.greatest(at + t["n"] + slack - start, F.lit(0)))
        return F.contains(F.concat(F.lit(" "), F.array_join(piece, " "), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))

    def proved(votes: Column) -> Column:
        # an anchor votes for a place once at most, as a place of the file holds one word
        counts = F.transform(F.array_distinct(votes), lambda at: F.struct(at.alias("at"), F.size(F.filter(votes, lambda v: v == at)).alias("n")))
        enough = F.filter(counts, lambda c: (c["n"] >= F.lit(least) * size) & F.forall(t["keys"], lambda k: near(c["at"], k)))
        return F.array_max(F.transform(enough, lambda c: c["n"])) / size

    return _bind(chosen, lambda c: _bind(F.transform(F.filter(hits, lambda x: F.array_contains(c, x["w"])), vote), proved))


def scan(docs: DataFrame, anchors: int = 8, least: float = 0.5, slack: int = 3) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = build_index(document_frequency(docs.select("text")))
    sep = PUNCT_ANYCASE
    # only files that hold a base phrase or a template's first key phrase are taken apart: no other can get a label
    cues = sorted({k[0] for _, _, k in TEMPLATES} | set(BASE))
    cue = "(?i)(?:^|" + sep + ")(?:" + "|".join(sep.join(map(re.escape, p.split())) for p in cues) + ")(?:$|" + sep + ")"
    d = docs.withColumn("n_words", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), sep), "")).cast("bigint"))
    d = d.withColumn("__w", F.when(F.col("text").rlike(cue), words(F.col("text"))))
    d = d.select(*docs.columns, "n_words", "__w", *[_places(F.col("__w"), p).alias(f"__b{i}") for i, p in enumerate(BASE)],
                 F.filter(F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary())).alias("__hits"))
    texts = lambda a: F.array(*map(F.lit, a))
    rows = [F.struct(texts([w for w, _ in posts]).alias("words"), texts([i for _, i in posts]).alias("at"), F.lit(len(t.split())).alias("n"), texts(keys).alias("keys"), F.lit(x).alias("label")) for posts, (x, t, keys) in zip(index, TEMPLATES, strict=True)]
    d = d.withColumn("__have", F.array_distinct(F.transform("__hits", lambda x: x["w"])))
    found = F.transform(F.array(*rows), lambda t: F.struct(t["label"].alias("label"), _score(t, F.col("__w"), F.col("__hits"), F.col("__have"), anchors, least, slack).alias("score")))
    d = d.withColumn("__found", F.when(F.size("__have") > 0, F.filter(found, lambda x: x["score"].isNotNull())))
    places = F.sort_array(F.flatten(F.array(*[F.coalesce(f"__b{i}", F.array().cast("array<int>")) for i in range(len(BASE))])))
    base = F.array_compact(F.array(*[F.when(F.size(f"__b{i}") > 0, F.lit(x)) for i, x in enumerate(BASE.values())]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    d = d.withColumn("__p", places)
    none = F.array().cast("array<string>")
    return d.select(
        *docs.columns, "n_words", F.size("__p").cast("bigint").alias("n_base"), F.get("__p", F.lit(0)).cast("bigint").alias("first_word"),
        F.when(F.size("__p") > 0, F.element_at("__p", -1)).cast("bigint").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.array_union(base, F.coalesce(F.transform("__found", lambda x: x["label"]), none))).alias("labels"),
        F.when(F.size("__p") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("__found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
