"""Custody of derivatives: whose the readable Markdown of a source is, and where it stays when the source moves or goes.

The manifest says where a source's derivative is; a file's ``derived-from`` says whose it
is, and is asked only before a file is written over, served or removed. A file of
another owner is never touched. What cannot be carried along is extracted again, which
needs no undoing: each step leaves the record true.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from inkmesh.functions import frontmatter
from inkmesh.functions.text import path_key


class Taken(Exception):
    """The place of a derivative is someone else's."""


def canonical(path: str, fmt: str | None) -> str | None:
    """Where a derivative is written; none for text, which is read as it is."""
    return None if fmt in ("md", "txt") else re.sub(r"\.[^./]*$", "", path) + ".md"


@dataclass
class Custody:
    """``recorded``: source to derivative, of the manifest."""

    root: Path
    recorded: Mapping[str, str | None]
    reported: dict[str, str] = field(default_factory=dict)
    removed: list[str] = field(default_factory=list)

    def exists(self, path: str) -> bool:
        return (self.root / path).exists()

    def origin(self, path: str) -> str | None:
        """The source that a file says it is derived from; none if it is no such file. A disk that cannot be read is an error."""
        if not (self.root / path).is_file():
            return None
        found = frontmatter.parse((self.root / path).read_bytes().decode("utf-8", "replace")).data.get("derived-from")
        return found if isinstance(found, str) else None

    def place(self, path: str, fmt: str, *owners: str) -> str:
        """Where to write the derivative of ``path``: its own name's place, or where its own already is if that place is another's. ``owners``: sources whose derivative it may replace."""
        target, kept, mine = canonical(path, fmt), next((d for o in owners if (d := self.recorded.get(o))), None), {path, *owners}
        if not self.exists(target) or self.origin(target) in mine:
            return target
        if kept and kept != target and self.origin(kept) in mine:
            return kept
        other = self.origin(target)
        raise Taken(f"derivative path {target} is already taken by {f'a derivative of {other}' if other else 'a user-placed file'}")

    # --- renames -------------------------------------------------------------------------

    def carry(self, renames: Iterable[tuple[str, str, str]]) -> dict[str, tuple[str | None, str | None]]:
        """For ``(old, new, format)``: new path -> (its derivative, why it has to be extracted again).

        A rename whose derivative stands where another's wants to go is settled before that
        one. In a ring nobody can go first: all keep the place they have.
        """
        by_old = {old: (old, new, fmt) for old, new, fmt in sorted(renames, key=lambda r: path_key(r[1]))}
        holder: dict[str, str] = {}
        for old in by_old:
            if at := self.recorded.get(old):
                holder.setdefault(at, old)
        out: dict[str, tuple[str | None, str | None]] = {}
        for first in by_old:
            chain = []
            old: str | None = first
            while old is not None and old not in chain and by_old[old][1] not in out:
                chain.append(old)
                old = holder.get(canonical(*by_old[old][1:]) or "")
            for link in reversed(chain):
                out[by_old[link][1]] = self._settled(*by_old[link])
        return out

    def _settled(self, old: str, new: str, fmt: str) -> tuple[str | None, str | None]:
        target, at = canonical(new, fmt), self.recorded.get(old)
        if target is None:
            return None, None
        if at is None:
            return None, f"no markdown was recorded for {old}, so {new} was extracted again"
        try:
            if self.origin(at) in (old, new):  # at the place on record a run that was cut short may have renamed it already
                free = at != target and not self.exists(target)
                self._repoint(at, new)
                if free:
                    (self.root / target).parent.mkdir(parents=True, exist_ok=True)
                    (self.root / at).rename(self.root / target)
                return target if free else at, None
            if not self.exists(at) and self.origin(target) == old:  # moved together with its source
                self._repoint(target, new)
                return target, None
        except (OSError, ValueError) as e:
            return None, f"could not carry the markdown of {old} to {new} — {e}; extracted again"
        return None, f"{at} could not be carried to {target} for {new}, so it was extracted again"

    def _repoint(self, path: str, source: str) -> None:
        if self.origin(path) == source:
            return
        text = frontmatter.replace_value((self.root / path).read_bytes().decode("utf-8"), "derived-from", source)
        if text is None:
            raise ValueError(f"the head of {path} cannot be changed")
        (self.root / path).write_text(text, encoding="utf-8", newline="")

    # --- what is left over ---------------------------------------------------------------

    def sweep(self, gone: Iterable[str]) -> dict[str, str]:
        """Removes the derivatives of sources that are gone; returns those that could not be, and why."""
        return {path: why for path in sorted(gone, key=path_key) if (at := self.recorded.get(path)) and (why := self._remove(at, path, path))}

    def superseded(self, old: str, new: str, settled: str | None, claimed: Iterable[str]) -> None:
        """Removes what stood on record for ``old`` once ``new`` has its derivative elsewhere, unless another source has it now."""
        at = self.recorded.get(old)
        if at and at != settled and at not in set(claimed) and (why := self._remove(at, new, old, new)):
            self.reported[new] = why

    def _remove(self, at: str, told: str, *owners: str) -> str | None:
        try:
            if self.exists(at) and self.origin(at) not in owners:
                self.reported[told] = f"left {at} alone — it is no longer the markdown of {owners[0]}"
            elif self.exists(at):
                (self.root / at).unlink()
                self.removed.append(at)
        except OSError as e:
            return f"could not delete {at} — {e}"
        return None
