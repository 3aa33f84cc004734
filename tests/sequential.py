"""A plain one-pass reading of a dump, character by character, to check the parallel scan."""

TRIM = " \t\n\r\0\x0b"


def _walk(line, state, strict):
    i = 0
    while i < len(line):
        c = line[i]
        if state == "":
            state = c if c in "'\"" else ""
        elif strict and c == "\\":
            i += 1
        elif c == state:
            if line[i + 1:i + 2] == state:
                i += 1
            elif strict or (len(line[:i]) - len(line[:i].rstrip("\\"))) % 2 == 0:
                state = ""
        i += 1
    return state


def split(data, dialect="import", strict=False, max_lines=10**9, max_bytes=10**12, delimiter=";"):
    """(statements, tail, end state); a statement is (first line, text)."""
    out, buffer, state, first, counted = [], "", "", None, 0
    lines = data.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    for no, line in enumerate(lines, 1):
        line = line.replace("\r\n", "\n").replace("\r", "\n")
        bare = line.strip(TRIM)
        if state == "":
            if bare.upper() == "DELIMITER" or bare.upper().startswith("DELIMITER "):
                value = bare[9:].strip(TRIM + "\f")
                if value not in ("", "0") and "\n" not in value:
                    delimiter = value
                continue
            if bare == "" or bare.startswith("#") or bare.startswith("-- "):
                continue
            if dialect == "import" and bare == "--":
                continue
        if len((buffer + line).encode()) > max_bytes:
            out.append((no, None))
            buffer, state, first, counted = "", "", None, 0
            continue
        first = first or no
        state = _walk(line, state, strict)
        buffer += line
        counted += state == ""
        if counted > max_lines:
            out.append((no, None))
            buffer, first, counted = "", None, 0
        elif state == "" and buffer.rstrip(TRIM).endswith(delimiter):
            text = buffer.strip(TRIM)[:-len(delimiter)].strip(TRIM)
            if text not in ("", "0"):
                out.append((first, text))
            buffer, first, counted = "", None, 0
    tail = buffer.strip(TRIM)
    if tail not in ("", "0") and tail.endswith(delimiter):
        tail = tail[:-len(delimiter)].strip(TRIM)
    return out, (None if tail in ("", "0") else tail), state
