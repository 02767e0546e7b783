"""Section-aware passages of long texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP = 700, 100
# Section names that need no capitals to be headers.
HEADERS = frozenset(
    "summary;professional summary;career summary;profile;objective;experience;work experience;professional experience;employment;employment history;education;"
    "skills;core skills;key skills;technical skills;core competencies;certifications;licenses and certifications;projects;key projects;publications;awards;"
    "achievements;languages;interests;volunteer experience;references".split(";")
)
_DASH = re.compile(r"\s[—–|·]\s|\s-\s")


def is_header(line: str) -> bool:
    """A known section name, or a short line whose part before a dash is in capitals."""
    bare = re.sub(r"[:\s]+$", "", line)
    if not 1 <= len(bare) <= 90:
        return False
    if bare.lower() in HEADERS:
        return True
    head = _DASH.split(bare, maxsplit=1)[0].strip()
    words = [w for w in head.split() if re.search(r"\w", w)]  # a bullet's mark is no word
    return bool(re.search("[A-Z]", head)) and head == head.upper() and len(words) <= 7 and (len(words) >= 2 or len(" ".join(words)) >= 6)


def passages(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Passages of about ``target`` characters that start with their section's header.

    Lines stay whole and the last ones, up to ``overlap`` characters, are repeated in the next passage; a line
    longer than the target is sliced. A header starts a new section without repeats. A passage of repeats
    alone is never given.
    """
    out: list[str] = []
    header = ""
    held: list[str] = []
    fresh = 0

    def size() -> int:
        return sum(map(len, held)) + max(0, len(held) - 1)

    def emit(lines: list[str]) -> None:
        out.append("\n".join([header, *lines] if header else lines))

    def close(keep: bool) -> None:
        nonlocal held, fresh
        if fresh:
            emit(held)
        carried: list[str] = []
        if keep:
            total = 0
            for line in reversed(held):
                if total + len(line) > overlap:
                    break
                carried.insert(0, line)
                total += len(line)
        held, fresh = carried, 0

    for line in (s.strip() for s in re.split(r"\r?\n", text)):
        if not line:
            continue
        if is_header(line):
            close(False)
            header = line
            continue
        budget = max(1, target - len(header) - 1)
        if len(line) > target:
            close(False)
            for i in range(0, len(line), budget):
                emit([line[i : i + budget]])
            continue
        if fresh and size() + len(line) > budget:
            close(True)
        held.append(line)
        fresh += 1
    close(False)
    return out


def chunk(df: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_text): null and blank texts have no passages."""
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b[key], b[text]) for i, p in enumerate(passages(t, target, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk_text"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {key_type}, chunk_index int, chunk_text string")
