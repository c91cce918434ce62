"""Op 2: licence scans with a positional index, asked with each file's rarest words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespark.llm.common import WORD_TABLE, chunks

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence notices and short licence texts (label, text as words, key phrases it must hold).
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["apache org licenses license 2 0"]),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", ["redistribution and use in source and binary forms", "this software is provided by the copyright holders and contributors as is"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("cc-by-4.0", "cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("epl-2.0", "eclipse public license v 2 0", ["eclipse public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software"]),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
    ("lgpl-3.0", "gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["permission is hereby granted free of charge", "the software is provided as is without warranty of any kind"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["in no event will the authors be held liable", "alter it and redistribute it freely"]),
]

#: Label, family and version of the licences that the GNU file header names.
GNU = [
    ("agpl-3.0", "gnu affero general public license", "3"),
    ("gpl-1.0", "gnu general public license", "1"),
    ("gpl-2.0", "gnu general public license", "2"),
    ("gpl-3.0", "gnu general public license", "3"),
    ("lgpl-2.0", "gnu library general public license", "2"),
    ("lgpl-2.0", "gnu lesser general public license", "2"),
    ("lgpl-2.1", "gnu lesser general public license", "2 1"),
    ("lgpl-3.0", "gnu lesser general public license", "3"),
]

#: The header's published forms: what follows the family, and the key phrase with the version.
GNU_FORMS = [
    ("either version {} of the license or at your option any later version", "version {} of the license"),
    ("either version {} or at your option any later version", "version {} or at your option"),
    ("version {} of the license", "version {} of the license"),
]

#: All notices.
NOTICES = TEMPLATES + [
    (label, f"{family} as published by the free software foundation {form.format(version)}", [family, key.format(version)])
    for label, family, version in GNU for form, key in GNU_FORMS
]


class LicenseIndex:
    """Positional index of the licence words, asked with each file's rarest ones.

    The postings of a word are the templates and the positions in them where it is
    obligatory (part of a key phrase). A file's licence words are taken by falling idf:
    each gives, for every posting, the alignments (place in the file less position in the
    template) at which the template may lie, and these are intersected template by
    template. A template is settled once ``RARE`` words of the file have agreed on its
    alignments, or none is left; one with an obligatory word that the file lacks can't
    occur. What is left is verified: the key phrases have to stand word by word, and
    ``share`` of all words has to agree.
    """

    RARE = 3

    def __init__(self, templates=NOTICES, idf: dict[str, float] | None = None, share: float = 0.8):
        self.share, self.idf = share, {w.encode(): x for w, x in (idf or {}).items()}
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        self.templates = []
        for k, (label, notice, phrases) in enumerate(templates):
            words = notice.encode().split()
            keys = [(at, phrase.encode().split()) for phrase in phrases for at in [self._place(words, phrase.encode().split())]]
            for place in sorted({at + i for at, p in keys for i in range(len(p))}):
                self.postings.setdefault(words[place], {}).setdefault(k, []).append(place)
            self.templates.append((label, words, keys, frozenset(w for _, p in keys for w in p)))

    @staticmethod
    def _place(words: list[bytes], phrase: list[bytes]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)

    def alignments(self, words: list[bytes], known: set[bytes]) -> dict[int, set[int]]:
        """Where each template may start, by the file's rarest licence words."""
        present = self.postings.keys() & known
        possible = {k for w in present for k in self.postings[w] if self.templates[k][3] <= present}
        if not possible:
            return {}
        places: dict[bytes, list[int]] = {w: [] for w in present}
        for at, word in enumerate(words):
            if word in places:
                places[word].append(at)
        aligned: dict[int, set[int]] = {}
        asked = Counter()
        # A word that no document had when idf was taken is the rarest of all.
        for word in sorted(present, key=lambda w: (self.idf.get(w, float("inf")), len(w), w), reverse=True):
            for k, spots in self.postings[word].items():
                if k in possible and asked[k] < self.RARE:
                    starts = {at - spot for at in places[word] for spot in spots}
                    aligned[k] = aligned[k] & starts if k in aligned else starts
                    asked[k] += 1
                    if not aligned[k]:
                        possible.discard(k)
        return {k: starts for k, starts in aligned.items() if starts}

    def notices(self, words: list[bytes], known: set[bytes]) -> dict[str, float]:
        """Labels with the largest share of a template's words that agree."""
        found: dict[str, float] = {}
        for k, starts in self.alignments(words, known).items():
            label, notice, keys, _ = self.templates[k]
            for start in starts:
                if any(start + p < 0 or words[start + p : start + p + len(q)] != q for p, q in keys):
                    continue
                same = sum(start + i >= 0 and words[start + i : start + i + 1] == [w] for i, w in enumerate(notice))
                if same / len(notice) >= self.share:
                    found[label] = max(found.get(label, 0.0), same / len(notice))
        return found


def base_places(words: list[bytes], known: set[bytes]) -> list[tuple[int, int, str]]:
    """First word, last word and label of every place of a base phrase."""
    found = []
    for phrase, label in BASE.items():
        parts = phrase.encode().split()
        if not known.issuperset(parts):
            continue
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, at + len(parts) - 1, label))
    return found


def word_idf(docs: DataFrame, vocabulary: set[str]) -> dict[str, float]:
    """log(N / documents with the word) over all documents, for the licence words.

    The result has one number for each word of the templates, whatever the corpus.
    """
    wanted = {w.encode() for w in vocabulary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for part in chunks(batch):
                for text in part.column(0):
                    seen.update(wanted & set((text.as_py() or b"").translate(WORD_TABLE).split()))
                n += part.num_rows
        words = [w.decode() for w in seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, ""], pa.string()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    n = {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop("", 0)
    return {w: math.log(max(1, total) / k) for w, k in n.items()}


def license_scan(docs: DataFrame, *, templates=NOTICES, share: float = 0.8) -> DataFrame:
    """Licences of every document row.

    Words are runs of [0-9a-z] and non-ASCII characters after A-Z are lower-cased; base
    phrases match wherever their words follow each other. The method's labels come from
    ``LicenseIndex`` with the corpus's own idf. ``score`` is the largest share of a
    notice that agrees; with base labels alone 0.5, without labels 0.

    Null and empty texts have no words and labels; repeated rows each get a row; other
    columns are ignored; an empty table gives no rows.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    """
    idf = word_idf(docs, {w for _, notice, _ in templates for w in notice.split()})
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long,"
           " base_labels string, labels string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates, idf, share)
        for batch in batches:
            for part in chunks(batch):
                rows = [_scanned(x.as_py() or b"", index) for x in part.column(1)]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, ddl)


def _scanned(text: bytes, index: LicenseIndex) -> tuple:
    words = text.translate(WORD_TABLE).split()
    known = set(words)
    places = base_places(words, known)
    notices = index.notices(words, known)
    base = {label for *_, label in places}
    return (
        len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None),
        ",".join(sorted(base)), ",".join(sorted(base | notices.keys())),
        max(notices.values(), default=0.5 if base else 0.0),
    )
