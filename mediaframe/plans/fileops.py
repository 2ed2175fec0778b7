"""Carrying out plans: moves, copies and renames with a status per item, each carried out once.

A plan is a DataFrame of source and target. Its rows are dealt to tasks, which act on a file system that
all of them share, and come back with a status; nothing is journalled that did not happen.

A task may be run twice, one after the other or side by side. So every item has a claim, a file that is created
exclusively and says what the source was before anything was done: size, time and place on the device. A name is
given to a file only where it is free, by a hard link or by an exclusive create, which one attempt wins. An
attempt that finds the target there asks whether it is what the claim says; if so it goes on from there, if not the
item is refused. A commit record beside the claim says that all of it is done. A plan that is run again with the claims of its
first run changes nothing and has the same statuses; without them a source that is gone is missing, whatever stands at the target.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.plans.storage import materialize, shared_dir

CHUNK = 1 << 20
OTHER_DEVICE = "other device"


# ---- claims -----------------------------------------------------------------------------------


def _facts(path: str) -> dict | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return {"size": s.st_size, "mtime": s.st_mtime_ns, "place": [s.st_dev, s.st_ino], "folder": os.path.isdir(path)}


def _digest(path: str) -> str:
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            out.update(chunk)
    return out.hexdigest()


class Claim:
    """What attempts at one item know of each other: the source's facts, the copy's digest, and that it is done."""

    def __init__(self, folder: str, source: str, target: str, operation: str):
        name = hashlib.sha256("\0".join((operation, source, target)).encode("utf-8", "surrogateescape")).hexdigest()
        self.path, self.part = f"{folder}/{name[:2]}/{name}", uuid.uuid4().hex

    def _read(self, kind: str) -> dict | None:
        try:
            with open(f"{self.path}.{kind}") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def write(self, kind: str, facts: dict) -> dict:
        """The record, or that of an attempt which was first; a record is there whole or not at all."""
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        own = f"{self.path}.{self.part}"
        with open(own, "w") as f:
            json.dump(facts, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, f"{self.path}.{kind}")
        except FileExistsError:
            facts = self._read(kind) or facts
        finally:
            os.unlink(own)
        return facts

    def take(self, facts: dict | None) -> dict | None:
        return self._read("claim") or (self.write("claim", facts) if facts else None)

    def drop(self) -> None:
        for kind in ("claim", "copy"):
            try:
                os.unlink(f"{self.path}.{kind}")
            except FileNotFoundError:
                pass

    @property
    def done(self) -> bool:
        return os.path.exists(f"{self.path}.done")

    @property
    def copied(self) -> dict | None:
        return self._read("copy")

    def made(self, target: str, facts: dict) -> bool:
        """Whether the target is this item's work: the claimed file itself, or the copy of it that an attempt noted."""
        now = _facts(target)
        if now is None:
            return False
        if now["place"] == facts["place"]:
            return True
        copy = self.copied
        return bool(copy) and not now["folder"] and now["size"] == copy["size"] and (now["place"] == copy["place"] or _digest(target) == copy["digest"])


# ---- single items -----------------------------------------------------------------------------


def _copy(source: str, target: str, claim: Claim, overwrite: bool) -> None:
    """In 1 MB chunks to a name beside the target, noted, and then given the target's name; the modification time is kept."""
    part = f"{target}.part-{claim.part}"
    try:
        digest, size = hashlib.sha256(), 0
        with open(source, "rb") as a, open(part, "xb") as b:
            while chunk := a.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
                b.write(chunk)
            b.flush()
            os.fsync(b.fileno())
        shutil.copystat(source, part)
        claim.write("copy", {"size": size, "digest": digest.hexdigest(), "place": _facts(part)["place"]})
        if overwrite:
            os.replace(part, target)
        else:
            _name(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def _name(source: str, target: str) -> None:
    """The target's name for the source's file, only where the name is free."""
    try:
        os.link(source, target)
    except OSError as e:
        if e.errno not in (errno.EPERM, errno.ENOTSUP, errno.EMLINK):
            raise
        with open(target, "xb"):  # no hard links here: the name is taken first, and then replaced
            pass
        os.replace(source, target)


def _remove(source: str, facts: dict) -> None:
    """The source of a move whose target stands, if it is still the claimed file."""
    now = _facts(source)
    if now and now["place"] == facts["place"]:
        try:
            os.unlink(source)
        except FileNotFoundError:
            pass


def act(source: str, target: str, operation: str, overwrite: bool = False, claims: str | None = None) -> str:
    """done, or what prevented it."""
    claim = Claim(claims or os.path.join(os.path.dirname(target) or ".", ".claims"), source, target, operation)
    try:
        if claim.done:
            return "done"
        facts = claim.take(_facts(source))
        if facts is None:
            return "missing"
        if os.path.abspath(target) == os.path.abspath(source):
            claim.drop()
            return "same"
        if os.path.abspath(target).startswith(os.path.abspath(source) + os.sep):
            claim.drop()
            return "nested"
        if not claim.made(target, facts):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            try:
                if os.path.lexists(target) and not overwrite:
                    raise FileExistsError
                _do(source, target, operation, overwrite, facts, claim)
            except (FileExistsError, FileNotFoundError) as e:  # another attempt was faster, or there is a stranger
                if not claim.made(target, facts):
                    claim.drop()
                    return "exists" if isinstance(e, FileExistsError) else "missing"
        if operation == "move" and not facts["folder"]:
            _remove(source, facts)
        claim.write("done", facts)
        return "done"
    except OSError as e:
        return OTHER_DEVICE if e.errno == errno.EXDEV else f"failed: {e.strerror or e}"


def _do(source: str, target: str, operation: str, overwrite: bool, facts: dict, claim: Claim) -> None:
    if facts["folder"]:
        if operation != "move":
            raise IsADirectoryError(errno.EISDIR, "a folder is copied by its files, see plans.folders")
        os.rename(source, target)  # whole, or not at all; an empty folder at the target gives way
    elif operation == "move":
        try:
            if overwrite:
                os.replace(source, target)
            else:
                _name(source, target)
        except OSError as e:
            if e.errno != errno.EXDEV:
                raise
            _copy(source, target, claim, overwrite)
    else:
        _copy(source, target, claim, overwrite)


def execute(plan: DataFrame, operation: str = "move", overwrite: bool = False, source: str = "source", target: str = "target", claims: str | None = None) -> DataFrame:
    """source, target, status of every item, carried out once and written down.

    claims: a folder on the shared file system; a plan that may be run again is given the same one.
    """
    held = (claims or shared_dir(plan.sparkSession, "claims")).removeprefix("file://")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(status=[act(a, b, operation, overwrite, held) for a, b in zip(pdf["source"], pdf["target"], strict=True)])

    rows = plan.select(F.col(source).alias("source"), F.col(target).alias("target")).dropDuplicates(["source", "target"])
    return materialize(rows.mapInPandas(go, "source string, target string, status string"), "executed")


def journalled(done: DataFrame, batch_id: str, operation: str = "move") -> DataFrame:
    """Journal rows of what was done."""
    return done.where("status = 'done'").select(F.lit(batch_id).alias("batch_id"), F.lit(operation).alias("operation"), F.col("source").alias("source_path"), F.col("target").alias("target_path"), F.lit("executed").alias("status"))


def upload_results(attempts: DataFrame) -> DataFrame:
    """attempts: id, code. status by the server's code: 0 uploaded, 1805 exists there, 105 and 119 end the run."""
    status = F.when(F.col("code") == 0, "uploaded").when(F.col("code") == 1805, "skipped").when(F.col("code").isin(105, 119), "aborted").otherwise("failed")
    return attempts.withColumn("status", status)
