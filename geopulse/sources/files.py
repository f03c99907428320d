"""Small files and folders in whatever file system a path names, from the driver."""

from pyspark.sql import SparkSession


class Folder:
    """A folder; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.path, self._jvm = path, context._jvm
        self._files = self._at("").getFileSystem(context._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below="") -> list[str]:
        """What lies in a folder; nothing if there is none."""
        if not self._files.exists(self._at(below)):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(below)))

    def sizes(self) -> dict[str, int]:
        """Bytes of the files of the folder but for those that readers of tables skip."""
        found = {s.getPath().getName(): s.getLen() for s in self._files.listStatus(self._at(""))}
        return {name: size for name, size in found.items() if not name.startswith(("_", "."))}

    def read(self, name: str) -> str:
        source = self._files.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, name: str, text: str):
        """A file that is there as a whole or not at all: it gets its name when it is complete."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/_{last}.draft" if folder else f"_{last}.draft"
        out = self._files.create(self._at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.move(draft, name)

    def move(self, name: str, to: str):
        self._files.mkdirs(self._at(to).getParent())
        if not self._files.rename(self._at(name), self._at(to)):
            raise OSError(f"{name} in {self.path} could not become {to}")

    def delete(self, name: str):
        """A file, or a folder with all in it; it may be gone already."""
        self._files.delete(self._at(name), True)
