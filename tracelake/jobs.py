"""Ingestion in a process of its own. Its state is a file of the case that it replaces every two seconds, so that any other process can follow or cancel it."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import threading
import time
import uuid
from pathlib import Path

#: Seconds between signs of life, and without one until a job counts as interrupted.
BEAT, SILENT = 2, 30
ENDED = ("done", "failed", "cancelled", "interrupted")


def _folder(case_root: str, case: str) -> Path:
    return Path(case_root) / case / "jobs"


def _put(path: Path, state: dict) -> None:
    new = path.with_suffix(f".{uuid.uuid4().hex}.new")
    new.write_text(json.dumps(state), encoding="utf-8")
    os.replace(new, path)


def start(case_root: str, case: str, sources: list[str]) -> str:
    """Begins to ingest and returns the job's id at once."""
    if not (Path(case_root) / case / "case.json").exists():
        raise ValueError(f"no case {case!r}")
    folder = _folder(case_root, case)
    folder.mkdir(exist_ok=True)
    job = f"{int(time.time())}-{uuid.uuid4().hex[:8]}"
    _put(folder / f"{job}.json", {"id": job, "phase": "scanning", "pid": None, "started": time.time(), "beat": time.time(), "sources": sources})
    command = [sys.executable, "-m", "tracelake", "--case-root", str(case_root), "job-run", case, job, *sources]
    with (folder / f"{job}.log").open("wb") as log:
        subprocess.Popen(command, stdout=log, stderr=log, stdin=subprocess.DEVNULL, start_new_session=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(p or "." for p in sys.path)})
    return job


def run(case_root: str, case: str, job: str, ingest) -> int:
    """The job itself: calls ingest(progress) and keeps its state. Returns the exit code."""
    path = _folder(case_root, case) / f"{job}.json"
    state = json.loads(path.read_text(encoding="utf-8")) | {"pid": os.getpid()}
    lock, stop = threading.Lock(), threading.Event()

    def put(**changes) -> None:
        with lock:
            if state["phase"] not in ENDED:
                state.update(changes, beat=time.time())
                _put(path, state)

    def beats() -> None:
        while not stop.wait(BEAT):
            put()

    def cancelled(*_) -> None:
        put(phase="cancelled")
        os._exit(3)

    signal.signal(signal.SIGTERM, cancelled)
    put()
    threading.Thread(target=beats, daemon=True).start()
    try:
        report = ingest(lambda phase: put(phase=phase))
        put(phase="done", files=len(report), rows=sum(r["rows"] for r in report), errors=sum(r["errors"] for r in report))
        return 0
    except Exception as e:
        put(phase="failed", error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        return 1
    finally:
        stop.set()


def status(case_root: str, case: str, job: str) -> dict:
    """The job's state; one that gave no sign of life for SILENT seconds is interrupted."""
    path = _folder(case_root, case) / f"{job}.json"
    if path.parent != _folder(case_root, case) or not path.exists():
        raise ValueError(f"no job {job!r}")
    state = json.loads(path.read_text(encoding="utf-8"))
    if state["phase"] not in ENDED and time.time() - state["beat"] > SILENT:
        state["phase"] = "interrupted"
    return state


def jobs(case_root: str, case: str) -> list[dict]:
    """All jobs of the case, oldest first."""
    return sorted((status(case_root, case, p.stem) for p in _folder(case_root, case).glob("*.json")), key=lambda s: s["started"])


def cancel(case_root: str, case: str, job: str) -> dict:
    """Ends a job that is under way; nothing of it is committed unless its commit had begun."""
    state = status(case_root, case, job)
    if state["phase"] not in ENDED and state["pid"]:
        try:
            os.kill(state["pid"], signal.SIGTERM)
        except ProcessLookupError:
            pass
        deadline = time.time() + 5 * BEAT
        while status(case_root, case, job)["phase"] not in ENDED and time.time() < deadline:
            time.sleep(0.1)
    return status(case_root, case, job)


def wait(case_root: str, case: str, job: str, seconds: float) -> dict:
    deadline = time.time() + seconds
    while (state := status(case_root, case, job))["phase"] not in ENDED and time.time() < deadline:
        time.sleep(0.2)
    return state


def cleanup(case_root: str, case: str) -> int:
    """Removes the states and logs of ended jobs; returns how many."""
    done = [s["id"] for s in jobs(case_root, case) if s["phase"] in ENDED]
    for job in done:
        for suffix in (".json", ".log"):
            (_folder(case_root, case) / f"{job}{suffix}").unlink(missing_ok=True)
    return len(done)
