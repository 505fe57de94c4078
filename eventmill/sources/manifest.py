"""Folders whose files count only once a manifest names them.

Tasks write files under names of their own and tell the job which; the job then puts
one small manifest in place by a rename. What failed, repeated or speculative tasks left
behind is named by none, so no reader sees it, and a job is seen whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

MANIFESTS = "_manifest"


@dataclass
class Written(WriterCommitMessage):
    """The files that one task has written, as dicts with at least `name`."""

    files: list[dict]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or address, on the driver or in a task."""
    return fs.FileSystem.from_uri(path.rstrip("/"))


def new_name(suffix: str) -> str:
    return f"part-{uuid.uuid4().hex}{suffix}"


def put_manifest(path: str, key: str, told: dict) -> None:
    """Set the manifest `key` at once, in the place of an earlier one of that key."""
    files, root = open_folder(path)
    files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
    draft = f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(json.dumps(told).encode())
    files.move(draft, f"{root}/{MANIFESTS}/{key}.json")


def manifests(path: str) -> dict[str, dict]:
    """All manifests by key; none where nothing was written yet."""
    files, root = open_folder(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    told = {}
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with files.open_input_stream(info.path) as text:
                told[info.base_name.removesuffix(".json")] = json.loads(text.read())
    return told


def drop_manifest(path: str, key: str) -> None:
    files, root = open_folder(path)
    files.delete_file(f"{root}/{MANIFESTS}/{key}.json")


def drop_files(path: str, messages: list[Written | None]) -> None:
    """Remove what the tasks of a failed job have told; leftovers of others are unseen."""
    files, root = open_folder(path)
    for message in messages:
        for told in message.files if message else []:
            files.delete_file(f"{root}/{told['name']}")
