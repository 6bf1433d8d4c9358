"""The resumable, self-tuning side of chunking: an iterator on the driver over chunk boundaries only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from keyweave.model import Bound, Chunk, saturating_add

# Start, least and greatest chunk size; growth allowed in a step; factor of an alarming overrun;
# samples that are collected before the size is fitted; default target in seconds.
START_SIZE, LEAST_SIZE, MOST_SIZE, GROWTH, ALARM, SAMPLES, TARGET_S = 1000, 10, 100_000, 1.5, 5, 10, 0.1


def lazy_p90(samples: list[float]) -> float:
    """The value that a tenth of the samples exceeds, by position; no interpolation."""
    return sorted(samples, reverse=True)[len(samples) // 10]


@dataclass
class SizeControl:
    """Chunk size from measured times: a tenth at once after an overrun, else fitted to the 90th percentile."""

    target_s: float = TARGET_S
    size: int = START_SIZE
    samples: list[float] = field(default_factory=list)

    def clamp(self, wanted: float) -> int:
        return int(max(LEAST_SIZE, min(MOST_SIZE, self.size * GROWTH, wanted)))

    def feedback(self, chunk_size: int, seconds: float) -> None:
        if chunk_size != self.size:
            return  # measured under another size
        if seconds > ALARM * self.target_s:
            self.size, self.samples = self.clamp(self.size / 10), []
            return
        self.samples.append(seconds)
        if len(self.samples) > SAMPLES:
            self.size, self.samples = self.clamp(self.size * self.target_s / lazy_p90(self.samples)), []


@dataclass
class BatchControl:
    """Keys of a change batch from time per key: every tenth sample fits the batch to the target."""

    target_s: float = 0.5
    size: int = 1000
    least: int = 5
    samples: list[float] = field(default_factory=list)

    def feedback(self, keys: int, seconds: float) -> None:
        if keys < 1:
            return
        self.samples.append(seconds / keys)
        if len(self.samples) >= SAMPLES:
            self.size, self.samples = max(self.least, int(self.target_s / lazy_p90(self.samples))), []


class WatermarkNotReady(Exception):
    """No chunk with both bounds is done yet."""


class Chunker:
    """Chunks of an integer key between low and high, with low and high watermarks and resume.

    `next()` gives the chunk below `low`, then [p, p + size), and one open chunk once p reaches `high`. Chunks may be
    finished in any order; the low watermark is the last one before which all are done.
    """

    def __init__(self, key: str, low: int, high: int, target_s: float = TARGET_S, size: int = START_SIZE):
        self.key, self.low, self.high = (key,), low, high
        self.control = SizeControl(target_s, size)
        self.pointer: int | None = None
        self.done = False
        self.resume_high: int | None = None
        self._mark: Chunk | None = None
        self._parked: dict[tuple | None, Chunk] = {}
        self._expected: tuple | None = None

    def resume(self, watermark: str, copied_high: int | None = None) -> None:
        """Start again at the saved chunk's lower bound; keys up to copied_high count as read."""
        chunk = Chunk.from_json(watermark)
        self.pointer = chunk.lower.values[0]
        self.resume_high = copied_high
        self._expected = chunk.lower.values

    def next(self) -> Chunk | None:
        if self.done:
            return None
        size = self.control.size
        if self.pointer is None:
            self.pointer = self.low
            return Chunk(self.key, None, Bound((self.low,), False), size)
        if self.pointer >= self.high:
            self.done = True
            return Chunk(self.key, Bound((self.pointer,)), None, size)
        lower, self.pointer = self.pointer, saturating_add(self.pointer, size)
        return Chunk(self.key, Bound((lower,)), Bound((self.pointer,), False), size)

    def __iter__(self) -> Iterator[Chunk]:
        while (chunk := self.next()) is not None:
            yield chunk

    def feedback(self, chunk: Chunk, seconds: float) -> None:
        """A chunk is done: move the low watermark over every finished neighbour and tune the size."""
        self._parked[chunk.lower and chunk.lower.values] = chunk
        while self._expected in self._parked:
            self._mark = self._parked.pop(self._expected)
            self._expected = self._mark.upper.values if self._mark.upper else ("end",)
        self.control.feedback(chunk.size, seconds)

    def low_watermark(self) -> str:
        if self._mark is None or self._mark.lower is None or self._mark.upper is None:
            raise WatermarkNotReady
        return self._mark.to_json()

    def above_high_watermark(self, value: int) -> bool:
        """Whether the copier has not reached the key, so that its changes need no replay."""
        if self.pointer is None:
            return True
        if self.done or (self.resume_high is not None and value <= self.resume_high):
            return False
        return value >= self.pointer


def drive(chunker: Chunker, work: Callable[[Chunk], float]) -> int:
    """Run work on every chunk in turn, feeding its seconds back; returns the number of chunks."""
    n = 0
    for chunk in chunker:
        chunker.feedback(chunk, work(chunk))
        n += 1
    return n
