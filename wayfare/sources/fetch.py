"""Control plane of remote files: conditional requests, a landing folder with validators, retries, change detection."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass

MOST = 2 << 30


@dataclass
class Fetched:
    """What a request brought: data is None where nothing has changed."""

    data: bytes | None
    etag: str = ""
    last_modified: str = ""
    sha: str = ""
    ignored: bool = False  # the server sent the same bytes again in spite of the validators


def get(url: str, etag: str = "", last_modified: str = "", sha: str = "", headers: dict[str, str] | None = None, timeout: float = 60) -> Fetched:
    request = urllib.request.Request(url, headers={**(headers or {}), **({"If-None-Match": etag} if etag else {}), **({"If-Modified-Since": last_modified} if last_modified else {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            data = r.read(MOST + 1)
            got = {k.lower(): v for k, v in r.headers.items()}
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return Fetched(None, etag, last_modified, sha)
        raise
    if len(data) > MOST:
        raise ValueError(f"{url} is above 2 GiB")
    digest = hashlib.sha256(data).hexdigest()
    same = digest == sha
    return Fetched(None if same else data, got.get("etag", ""), got.get("last-modified", ""), digest, same and bool(etag or last_modified))


def retried(what: Callable[[], Fetched], first: float = 15, most: float = 300, times: int = 8, sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """``what()``, again after waits that double from ``first`` to ``most`` seconds."""
    wait = first
    for n in range(times):
        try:
            return what()
        except (OSError, ValueError):
            if n == times - 1:
                raise
            sleep(wait)
            wait = min(2 * wait, most)
    raise AssertionError


class Landing:
    """A folder of payloads with their validators; another url under a name makes the old payload invalid."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def meta(self, name: str, url: str) -> dict:
        try:
            with open(self._path(name) + ".meta.json", encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, ValueError):
            return {}
        return got if got.get("url") == url and os.path.exists(self._path(name)) else {}

    def _put(self, path: str, data: bytes) -> None:
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)  # readers see the old file or the new one

    def refresh(self, name: str, url: str, headers: dict[str, str] | None = None) -> bool:
        """Whether the payload has changed."""
        old = self.meta(name, url)
        got = get(url, old.get("etag", ""), old.get("last_modified", ""), old.get("sha", ""), headers)
        if got.data is not None:
            self._put(self._path(name), got.data)
        self._put(self._path(name) + ".meta.json", json.dumps({**{k: v for k, v in asdict(got).items() if k not in ("data", "ignored")}, "url": url}).encode())
        return got.data is not None
