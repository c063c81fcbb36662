"""Requests that are tried again."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Collection


def ask(request: urllib.request.Request, retried: Collection[int], tries: int = 4, wait: float = 2.0, timeout: float = 60, read: Callable = lambda answer: answer.read()):
    """What ``read`` makes of the answer, or None. Statuses in ``retried`` and network errors are tried again after ``wait`` seconds, twice that and so on; other errors aren't."""
    for n in range(tries):
        if n:
            time.sleep(wait * n)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return read(answer)
        except urllib.error.HTTPError as e:
            if e.code not in retried:
                return None
        except (urllib.error.URLError, TimeoutError):
            pass
    return None
