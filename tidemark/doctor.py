"""Host checks: what a driver's machine has, each with a state and a detail."""

from __future__ import annotations

import platform
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path


@dataclass
class Check:
    name: str
    state: str  # ok, warn or fail
    detail: str


def _hugepages(required: bool, meminfo: str) -> Check:
    facts = {k.strip(): v.split() for k, _, v in (line.partition(":") for line in meminfo.splitlines())}
    first = lambda k: facts[k][0] if facts.get(k) and facts[k][0].isdigit() else "0"
    if total := int(first("HugePages_Total")):
        return Check("hugepages", "ok", f"total={total} free={first('HugePages_Free')} size={' '.join(facts.get('Hugepagesize', [])) or 'unknown'}")
    return Check("hugepages", "fail" if required else "warn", "no huge pages are set aside")


def _device(address: str, root: Path) -> Check:
    place = root / "bus/pci/devices" / address
    if not place.exists():
        return Check(f"pci {address}", "fail", "no such device")
    driver = place / "driver"
    return Check(f"pci {address}", "ok", f"driver={driver.resolve().name}") if driver.exists() else Check(f"pci {address}", "warn", "no driver is bound")


def checks(require_hugepages: bool = False, folders: Sequence[str] = (), devices: Sequence[str] = (), proc: str = "/proc", sys: str = "/sys") -> list[Check]:
    """The kernel, huge pages, VFIO, folders that must be there, and devices."""
    try:
        meminfo = (Path(proc) / "meminfo").read_text()
    except OSError:
        meminfo = ""
    vfio = Path(sys, "bus/pci/drivers/vfio-pci").exists()
    out = [Check("kernel", "ok", f"{platform.system().lower()} {platform.release()}"), _hugepages(require_hugepages, meminfo), Check("vfio", "ok" if vfio else "warn", "the driver is there" if vfio else "no such driver")]
    out += [Check(f"folder {f}", *(("ok", "is there") if Path(f).is_dir() else ("fail", "is missing"))) for f in folders]
    return out + [_device(d, Path(sys)) for d in devices if d.strip()]


def report(found: Iterable[Check]) -> int:
    """Print the checks; how many failed."""
    failed = 0
    for c in found:
        print(f"{c.name}: {c.state}, {c.detail}")
        failed += c.state == "fail"
    print(f"{failed} checks failed")
    return failed
