"""Files on any file system, from within tasks."""


def file_system(path: str):
    """File system and path within it; a path without scheme is a local one."""
    from pyarrow import fs

    scheme, separator, rest = path.partition(":")
    if not separator or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # object stores go by another name there
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else path)


def size_of(path: str) -> int:
    system, inner = file_system(path)
    return system.get_file_info(inner).size
