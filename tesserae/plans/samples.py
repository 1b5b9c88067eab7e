"""A small Java project, so that the adapter of Java sources can be run and checked anywhere."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tesserae.storage import fresh_path

SOURCES = {
    "web/OrderController.java": """package lib.web;

import lib.store.OrderStore;
import org.springframework.stereotype.Controller;

@Controller
public class OrderController {
  private final OrderStore store;
  private final lib.service.Pricing pricing = null;

  public int total(java.util.List<String> ids) {
    int sum = 0;
    for (String id : ids) {
      sum += store.load(id);
    }
    return pricing.round(sum);
  }

  static class Page {
    OrderController owner;
  }
}
""",
    "service/Pricing.java": """package lib.service;

import org.springframework.stereotype.Service;

@Service
public class Pricing implements Rounding {
  /* a comment with store.load("x") in it */
  public int round(int value) {
    while (value % 5 != 0) value = next(value);
    return value;
  }

  private int next(int value) { return value + 1; }
}

interface Rounding {
  int round(int value);
}
""",
    "store/OrderStore.java": """package lib.store;

import org.springframework.data.repository.CrudRepository;

public interface OrderStore extends CrudRepository<String, Long> {
  int load(String id);
}

class FileStore implements OrderStore {
  public int load(String id) { return open(id).length(); }
  private String open(String id) { return id; }
}

class CachedStore extends FileStore {
}
""",
}


def project(spark: SparkSession) -> str:
    """The sources as files in the shared folder; returns their root."""
    root, context = fresh_path(spark, "sources"), spark.sparkContext
    for name, text in SOURCES.items():
        path = context._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return root
