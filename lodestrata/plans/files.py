"""Small files through Hadoop's file system API: wherever Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        files, target = self._at(path)
        return files.exists(target)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no folder. Errors aren't taken for absence."""
        files, target = self._at(path)
        return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []

    def below(self, path: str) -> list[tuple[str, int, int]]:
        """Path relative to the folder, length and time of change (ms) of all files below it."""
        files, target = self._at(path)
        if not files.exists(target):
            return []
        root, out, found = files.makeQualified(target).toUri().getPath(), [], files.listFiles(target, True)
        while found.hasNext():
            x = found.next()
            out.append((x.getPath().toUri().getPath()[len(root) :].strip("/"), x.getLen(), x.getModificationTime()))
        return sorted(out)

    def read(self, path: str) -> str:
        files, target = self._at(path)
        stream = files.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a file, in place of one that is there."""
        files, target = self._at(path)
        stream = files.create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write_new(self, path: str, text: str, temporary: str) -> bool:
        """Write a file under its name at once and whole, by renaming `temporary`; False
        if there is one of that name."""
        self.write(temporary, text)
        jvm, (files, target) = self.spark._jvm, self._at(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._at(temporary)[1], target, never_replace)
        except Exception:
            there = files.exists(target)
            self.delete(temporary)
            if there:
                return False
            raise
        return True

    def make_folder(self, path: str) -> None:
        files, target = self._at(path)
        files.mkdirs(target)

    def delete(self, path: str) -> None:
        files, target = self._at(path)
        files.delete(target, True)
