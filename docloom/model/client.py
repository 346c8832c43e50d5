"""Model calls from DataFrames: a pluggable backend inside Arrow batches, with retries, a breaker and accounting."""

from __future__ import annotations

import base64
import json
import mimetypes
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_IMAGE = 4 << 20
CALL_SCHEMA = "reply string, ok boolean, error string, tokens_in bigint, tokens_out bigint, attempts int"


class ModelError(RuntimeError):
    """A call that failed after all retries."""


@dataclass
class Backend:
    """Something that completes a prompt. Instances are made on the driver and pickled to the workers."""

    def complete(self, prompt: str, temperature: float = 0.0, most: int = 1000, images: tuple[str, ...] = ()) -> str:
        raise NotImplementedError


@dataclass
class Offline(Backend):
    """A deterministic stand-in without a network: answers come from the text between the prompt's markers.

    It extracts sentences of the source; which, depends only on the prompt. So a pipeline runs and repeats exactly.
    """

    def complete(self, prompt: str, temperature: float = 0.0, most: int = 1000, images: tuple[str, ...] = ()) -> str:
        task = re.search(r"^TASK: (\w+)", prompt)
        source = re.search(r"<<<\n(.*?)\n>>>", prompt, re.S)
        body = source.group(1) if source else prompt
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", body) if len(s.split()) >= 5 and re.search(r"[a-z]", s)]
        name = task.group(1) if task else "answer"
        if name in ("qa", "multihop", "cross_document", "figure_qa"):
            wanted = int((re.search(r"COUNT: (\d+)", prompt) or [0, "3"])[1])
            rows = []
            for s in sentences[:wanted]:
                subject = " ".join(s.split()[:4]).rstrip(".,;:")
                rows.append({"question": f"What does the source report about {subject}?", "answer": s, "hops": 2 if name in ("multihop", "cross_document") else 1})
            return json.dumps(rows, ensure_ascii=False)
        if name == "multiturn":
            turns = []
            for s in sentences[:3]:
                turns += [{"role": "user", "content": f"Can you explain {' '.join(s.split()[:4])}?"}, {"role": "assistant", "content": s}]
            return json.dumps(turns, ensure_ascii=False)
        if name == "judge":
            claim = re.search(r"CLAIM: (.*)", prompt)
            words = set(re.findall(r"\w{4,}", (claim.group(1) if claim else "").lower()))
            share = len(words & set(re.findall(r"\w{4,}", body.lower()))) / max(1, len(words))
            return json.dumps({"label": "entailment" if share >= 0.6 else "neutral", "confidence": round(share, 3)})
        if name == "reverse":
            return json.dumps({"answerable_without_source": False, "matches_source_answer": False, "confidence": 0.9})
        if name in ("symbolic", "solver"):
            return json.dumps({"applicable": False})
        if name == "grade":
            both = [set(re.findall(r"\w+", m.group(1).lower())) if (m := re.search(rf"^{mark}: (.*)", prompt, re.M)) else set() for mark in ("REFERENCE", "CANDIDATE")]
            share = len(both[0] & both[1]) / max(1, len(both[0]))
            return json.dumps({"verdict": "correct" if share >= 0.8 else "partial" if share >= 0.4 else "incorrect", "missing": [], "wrong": []})
        if name == "react":
            number = re.search(r"\d+(?:\.\d+)?", body)
            term = sentences[0].split()[0] if sentences else "nothing"
            trace = [{"thought": "Find it in the text.", "action": "lookup", "action_input": number.group() if number else term, "observation": sentences[0] if sentences else ""}]
            return json.dumps({"question": f"What does the source say about {term}?", "answer": sentences[0] if sentences else "", "trace": trace}, ensure_ascii=False)
        if name == "evolve":
            question, answer = (re.search(rf"^{mark}: (.*)", prompt, re.M) for mark in ("QUESTION", "ANSWER"))
            return json.dumps({"applied": bool(question and answer), "question": f"Considering everything the source says: {question.group(1) if question else ''}", "answer": answer.group(1) if answer else ""}, ensure_ascii=False)
        if name == "entities":
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", body)))[:6]
            return json.dumps({"entities": [{"name": n, "type": "concept"} for n in names], "relations": [{"source": a, "target": b, "relation": "related_to"} for a, b in zip(names, names[1:])]})
        if name == "clarity":
            return json.dumps({"standalone": 0.9, "specific": 0.9, "natural": 0.8, "answer_complete": 0.9})
        if name == "reject":
            answer = re.search(r"ANSWER: (.*)", prompt)
            text = answer.group(1) if answer else ""
            return re.sub(r"\d+", lambda m: str(int(m.group()) + 7), text) if re.search(r"\d", text) else f"It is not the case that {text[:1].lower()}{text[1:]}"
        if name == "rewrite":
            question = re.search(r"QUESTION: (.*)", prompt)
            return f"In plain words: {question.group(1) if question else ''}"
        return sentences[0] if sentences else "UNANSWERABLE"


@dataclass
class Http(Backend):
    """A chat endpoint over HTTP. dialect: openai, anthropic or ollama."""

    url: str = ""
    model: str = ""
    key: str = ""
    dialect: str = "openai"
    timeout: float = 120.0
    headers: dict[str, str] = field(default_factory=dict)

    def complete(self, prompt: str, temperature: float = 0.0, most: int = 1000, images: tuple[str, ...] = ()) -> str:
        content: object = prompt
        if images:
            shown = [encoded_image(p) for p in images]
            if self.dialect == "anthropic":
                content = [{"type": "image", "source": {"type": "base64", "media_type": m, "data": d}} for m, d in shown] + [{"type": "text", "text": prompt}]
            elif self.dialect == "openai":
                content = [{"type": "image_url", "image_url": {"url": f"data:{m};base64,{d}"}} for m, d in shown] + [{"type": "text", "text": prompt}]
        message = {"role": "user", "content": content} | ({"images": [encoded_image(p)[1] for p in images]} if images and self.dialect == "ollama" else {})
        body = {"model": self.model, "messages": [message]}
        body |= {"stream": False, "options": {"temperature": temperature, "num_predict": most}} if self.dialect == "ollama" else {"temperature": temperature, "max_tokens": most}
        auth = {"x-api-key": self.key, "anthropic-version": "2023-06-01"} if self.dialect == "anthropic" else {"Authorization": f"Bearer {self.key}"} if self.key else {}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **auth, **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            data = json.load(reply)
        if self.dialect == "anthropic":
            return "".join(p.get("text", "") for p in data.get("content", []))
        return data["message"]["content"] if self.dialect == "ollama" else data["choices"][0]["message"]["content"]


def encoded_image(path: str) -> tuple[str, str]:
    """(type, base64) of an image file of at most four megabytes."""
    with open(path, "rb") as file:
        content = file.read(MOST_IMAGE + 1)
    if len(content) > MOST_IMAGE:
        raise ModelError(f"{path} is larger than {MOST_IMAGE} bytes")
    return mimetypes.guess_type(path)[0] or "image/png", base64.b64encode(content).decode()


@dataclass
class Caller:
    """Retries with growing pauses and a breaker that stops calling a backend after `dead` failures in a row."""

    backend: Backend
    retries: int = 2
    pause: float = 1.0
    dead: int = 5
    failures: int = 0

    def __call__(self, prompt: str, temperature: float, most: int, images: tuple[str, ...] = ()) -> tuple[str | None, str | None, int]:
        error = "the backend is taken to be dead"
        if self.failures >= self.dead:
            return None, error, 0
        for attempt in range(self.retries + 1):
            try:
                reply = self.backend.complete(prompt, temperature, most, images) if images else self.backend.complete(prompt, temperature, most)
                self.failures = 0
                return reply, None, attempt + 1
            except (OSError, ValueError, KeyError, ModelError, urllib.error.URLError) as problem:
                error = f"{type(problem).__name__}: {problem}"[:300]
                wait = self.pause * 2**attempt
                if isinstance(problem, urllib.error.HTTPError):
                    if problem.code not in (408, 409, 425, 429) and problem.code < 500:
                        break
                    wait = float(problem.headers.get("Retry-After") or wait)
                if attempt < self.retries:
                    time.sleep(min(wait, 60.0))
        self.failures += 1
        return None, error, self.retries + 1


def completed(prompts: DataFrame, backend: Backend, prompt: str = "prompt", temperature: float = 0.0, most: int = 1000, retries: int = 2, role: str = "generate", images: str | None = None, json_reply: bool = False) -> DataFrame:
    """The frame with reply, ok, error, tokens_in, tokens_out and attempts. A failed call is a row with ok = false, not an error.

    images: a column of paths that go with the prompts. With a Runtime the backend is that of the role, the calls are added to
    its tally, and a wave beyond its budget is refused; json_reply counts replies that hold no JSON. Model calls cost money and
    differ between runs: cut the result before it is used twice.
    """
    from docloom.model.runtime import Runtime, readable

    tally = None
    if isinstance(backend, Runtime):
        backend.admit(role)
        backend, tally = backend.of(role), backend.tally
    names = prompts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", " + CALL_SCHEMA
    at, shown = names.index(prompt), names.index(images) if images else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = Caller(backend, retries)
        for batch in batches:
            pictures = batch.column(shown).to_pylist() if shown is not None else [()] * batch.num_rows
            rows = [(text, *call(text or "", temperature, most, tuple(paths or ()))) for text, paths in zip(batch.column(at).to_pylist(), pictures)]
            spent = [max(1, len(r[0] or "") // 4) for r in rows], [max(1, len(r[1]) // 4) if r[1] else 0 for r in rows]
            columns = [
                pa.array([r[1] for r in rows], pa.string()), pa.array([r[1] is not None for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string()),
                pa.array(spent[0], pa.int64()), pa.array(spent[1], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
            ]
            if tally is not None and rows:
                unread = sum(r[1] is not None and not readable(r[1]) for r in rows) if json_reply else 0
                tally.add({(role, "calls"): len(rows), (role, "failures"): sum(r[1] is None for r in rows), (role, "unparsed"): unread, (role, "tokens_in"): sum(spent[0]), (role, "tokens_out"): sum(spent[1])})
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "reply", "ok", "error", "tokens_in", "tokens_out", "attempts"])

    return prompts.mapInArrow(work, schema)


BACKENDS: dict[str, Callable[..., Backend]] = {"offline": Offline, "http": Http}
