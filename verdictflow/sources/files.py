"""The few file-system questions Spark's reader and writer do not answer.

Claims and renames ask for a file system on which a file is created by one writer only and a
rename is atomic, such as HDFS; object stores without these are not supported.
"""

import os

from py4j.protocol import Py4JJavaError


def _handle(spark, path):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark, path) -> bool:
    fs, hadoop_path = _handle(spark, path)
    return fs.exists(hadoop_path)


def child_names(spark, path) -> list[str]:
    """Names directly below a folder, none when it is missing."""
    fs, hadoop_path = _handle(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def create(spark, path) -> bool:
    """Create an empty file; False when it exists, also when another job just made it."""
    fs, hadoop_path = _handle(spark, path)
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        local = hadoop_path.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        return fs.createNewFile(hadoop_path)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def make_folder(spark, path):
    fs, hadoop_path = _handle(spark, path)
    fs.mkdirs(hadoop_path)


def modified(spark, path) -> float:
    """Time of the last change, in seconds since 1970."""
    fs, hadoop_path = _handle(spark, path)
    return fs.getFileStatus(hadoop_path).getModificationTime() / 1000


def move(spark, source, target) -> bool:
    fs, hadoop_path = _handle(spark, source)
    return fs.rename(hadoop_path, spark._jvm.org.apache.hadoop.fs.Path(target))


def remove(spark, path):
    fs, hadoop_path = _handle(spark, path)
    fs.delete(hadoop_path, True)
