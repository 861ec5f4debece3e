"""Users with privileges, salted and iterated password hashes, and sessions."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
import time
from dataclasses import asdict, dataclass, field

PRIVILEGES = ("query", "load", "unload", "update", "backup", "restore", "export")
ROUNDS = 100_000


class Denied(PermissionError):
    """Wrong credentials, or a missing privilege."""


@dataclass
class User:
    name: str
    salt: str
    digest: str
    admin: bool = False
    privileges: list = field(default_factory=list)


def digest(password: str, salt: str) -> str:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), ROUNDS).hex()


class Users:
    def __init__(self, root_password: str, session_seconds: float = 3600.0):
        self.users: dict[str, User] = {}
        self.sessions: dict[str, tuple[str, float]] = {}
        self.session_seconds = session_seconds
        self.add("root", root_password, admin=True)

    def add(self, name: str, password: str, admin: bool = False) -> None:
        if name in self.users:
            raise ValueError(f"user {name!r} exists")
        salt = secrets.token_hex(16)
        self.users[name] = User(name, salt, digest(password, salt), admin)

    def remove(self, name: str) -> None:
        if name == "root":
            raise ValueError("root stays")
        del self.users[name]
        self.sessions = {k: v for k, v in self.sessions.items() if v[0] != name}

    def set_password(self, name: str, password: str) -> None:
        u = self.users[name]
        u.salt = secrets.token_hex(16)
        u.digest = digest(password, u.salt)

    def grant(self, name: str, privilege: str, on: bool = True) -> None:
        if privilege not in PRIVILEGES:
            raise ValueError(f"unknown privilege {privilege!r}")
        kept = [p for p in self.users[name].privileges if p != privilege]
        self.users[name].privileges = [*kept, privilege] if on else kept

    def check(self, name: str, password: str) -> User:
        u = self.users.get(name)
        if u is None or not hmac.compare_digest(u.digest, digest(password, u.salt)):
            raise Denied("wrong name or password")
        return u

    def login(self, name: str, password: str) -> str:
        self.check(name, password)
        token = secrets.token_urlsafe(24)
        self.sessions[token] = (name, time.monotonic() + self.session_seconds)
        return token

    def logout(self, token: str) -> bool:
        return self.sessions.pop(token, None) is not None

    def of_session(self, token: str) -> User:
        name, until = self.sessions.get(token, ("", 0.0))
        if time.monotonic() > until or name not in self.users:
            self.sessions.pop(token, None)
            raise Denied("no session")
        return self.users[name]

    @staticmethod
    def require(user: User, privilege: str | None) -> None:
        if privilege and not user.admin and privilege not in user.privileges:
            raise Denied(f"{user.name} may not {privilege}")
        if privilege is None and not user.admin:
            raise Denied(f"{user.name} is not an administrator")

    def to_json(self) -> str:
        return json.dumps([asdict(u) for u in self.users.values()])

    def load_json(self, text: str) -> None:
        self.users = {u["name"]: User(**u) for u in json.loads(text)}
