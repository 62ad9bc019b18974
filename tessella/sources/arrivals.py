"""The files of a folder as a stream: all of them, hidden and empty ones too, each version once.

A listing that finds new or changed files (by path, time of change and length) admits them: they become a
numbered file of the log, which is written whole and never changed. An offset is such a number, so a
batch is the files of the admissions after its start up to its end, whoever asks and however often: a stream that
starts again from its checkpoint, in another process too, reads what it had not finished and nothing
twice. The top folders are listed beside each other.

The folder and the log are on a disk that the driver and all executors mount. The driver holds
the names of all files that were ever admitted; their content only the tasks. A file that
went before it was read is a row with null content; one that is written while it is listed is
admitted again with its new length.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .objects import SCHEMA

LISTERS = 16


class _Arrived(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path, time of change in ns, length) of all files under root, in order."""

    def under(top: str) -> list[tuple[str, int, int]]:
        out = []
        for folder, _, names in os.walk(top):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:  # it went meanwhile
                    continue
                out.append((path, stat.st_mtime_ns, stat.st_size))
        return out

    own, tops = [], []
    with os.scandir(root) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                tops.append(e.path)
            elif e.is_file():
                own.append((e.path, e.stat().st_mtime_ns, e.stat().st_size))
    with ThreadPoolExecutor(LISTERS) as pool:
        for found in pool.map(under, tops):
            own += found
    return sorted(own)


class Admissions:
    """The log: numbered files of (path, time, length) lines."""

    def __init__(self, path: str):
        self.path, self.read_to, self.known = path, 0, {}
        os.makedirs(path, exist_ok=True)

    def _name(self, n: int) -> str:
        return os.path.join(self.path, f"{n:012d}.jsonl")

    def files(self, start: int, end: int) -> list[tuple[str, int, int]]:
        out = []
        for n in range(start + 1, end + 1):
            with open(self._name(n), encoding="utf-8", errors="surrogateescape") as f:
                out += [tuple(json.loads(line)) for line in f]
        return out

    def last(self) -> int:
        """The greatest number; what others have admitted is known from then on."""
        n = self.read_to
        while os.path.exists(self._name(n + 1)):
            n += 1
        for path, *version in self.files(self.read_to, n):
            self.known[path] = version
        self.read_to = n
        return n

    def admit(self, found: list[tuple[str, int, int]]) -> int:
        """The number after found is admitted; the last one if all of it was known."""
        n = self.last()
        new = [f for f in found if self.known.get(f[0]) != list(f[1:])]
        if new:
            part = os.path.join(self.path, f".{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8", errors="surrogateescape") as f:
                f.writelines(json.dumps(x) + "\n" for x in new)
            try:
                os.link(part, self._name(n + 1))  # fails if another stream was faster
            except FileExistsError:
                return self.admit(found)
            finally:
                os.unlink(part)
            return self.last()
        return n


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = re.sub("^file:(//)?", "", options["path"])
        self.log = Admissions(re.sub("^file:(//)?", "", options["log"]))
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.most = int(options.get("maxLength", 1 << 30))

    def initialOffset(self) -> dict:
        return {"admitted": 0}

    def latestOffset(self) -> dict:
        return {"admitted": self.log.admit(listed(self.root))}

    def partitions(self, start: dict, end: dict) -> list[_Arrived]:
        newest = {f[0]: f for f in self.log.files(start["admitted"], end["admitted"])}
        out, held = [], 0
        for f in sorted(newest.values()):
            if not out or held + f[2] + 4096 > self.bytes:
                out.append([])
                held = 0
            out[-1].append(f)
            held += f[2] + 4096
        return [_Arrived(x) for x in out]

    def read(self, partition: _Arrived) -> Iterator[tuple]:
        for path, changed, length in partition.files:
            content = None
            if length <= self.most:
                try:
                    with open(path, "rb") as f:
                        content = f.read(self.most + 1)
                except OSError:  # it went; null content says so
                    pass
            if content is not None:
                length = len(content)
                content = content if length <= self.most else None
            yield path, datetime.fromtimestamp(changed / 1e9, timezone.utc), length, content

    def commit(self, end: dict) -> None:
        pass


class ArrivalSource(DataSource):
    """Options: path; log, a folder of its own; partitionBytes; maxLength (longer files have null content)."""

    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options)


def arrivals(spark: SparkSession, path: str, log: str, **options) -> DataFrame:
    """A stream of the files under path (columns as of read_objects)."""
    spark.dataSource.register(ArrivalSource)
    return spark.readStream.format("arrivals").options(log=log, **{k: str(v) for k, v in options.items()}).load(path)
