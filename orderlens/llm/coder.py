"""The context-mixing range coder of token ids, as a JVM function.

Python workers would spend microseconds on each bit. The coder is therefore a small Java class; Spark's own
bundled expression compiler (Janino) turns its source, below, into a jar on the driver, and executors get the
jar like any that is added to a session. A block in the coded form is

    width (1 byte: 2 or 4) | bits (1 byte) | number of ids (4 bytes) | CRC-32 of the ids (4 bytes) | code

with the ids as little-endian numbers of ``width`` bytes, and integers big-endian. Every block starts from
the same state, so blocks are coded and read independently.

An id is coded by up to three decisions. The order-2 context (the two ids before, hashed) and the order-1 context
(the id before) each name the id that followed them lately, and how surely; order 0 counts ids. The likeliest two
names are offered in turn, and the chance that an offer is right mixes, in the logistic domain and with weights that
are learned, what orders 2, 1 and 0 say of that id. An id that neither offer names is coded by the order-0 counts, kept as
sums of left halves in a binary tree, so that one walk finds an id's interval and updates it. All decisions drive one range
coder with 56-bit bounds and carries.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T

JAVA = r"""
package orderlens;

import java.util.Arrays;
import java.util.zip.CRC32;

public class MixCoder {
  static final long TOP = 1L << 56, LEAST = 1L << 40;
  static final int SLOTS1 = 16, SLOTS2 = 17, STEP = 24, KINDS = 18;
  static final int[] STRETCH = new int[4096];
  static final int[] SQUASH = new int[4096];
  static {
    for (int i = 0; i < 4096; i++) {
      SQUASH[i] = Math.max(32, Math.min(65504, (int) Math.round(65536.0 / (1.0 + Math.exp(-(i - 2048) / 256.0)))));
      double p = (i + 0.5) / 4096.0;
      STRETCH[i] = (int) Math.max(-2047, Math.min(2047, Math.round(256.0 * Math.log(p / (1.0 - p)))));
    }
  }

  final int bits;
  // order 0: the counts of ids, and at each node of a binary tree over them the count of its left half
  final int[] own, left;
  int total;
  // orders 1 and 2: ids (plus one) that followed a context, the likeliest first, and how often it did lately
  final int[] first1 = new int[1 << SLOTS1], second1 = new int[1 << SLOTS1], first2 = new int[1 << SLOTS2];
  final byte[] sure1 = new byte[1 << SLOTS1], sure2 = new byte[1 << SLOTS2];
  // for each of two guesses: chances of a hit by what each order says of it, and the weights that mix them
  final int[] chance = new int[2 * 3 * KINDS], weights = new int[2 * 3];
  int before1 = -1, before2 = -1;
  int at1, at2, c0, c1, c2, s0, s1, s2, set, mixed;
  int guess1, guess2;
  long low = 0L, range = TOP - 1, code = 0L;
  byte[] out;
  int size;
  byte[] in;
  int next;

  MixCoder(int bits) {
    this.bits = bits;
    own = new int[1 << bits];
    left = new int[1 << bits];
    Arrays.fill(own, 1);
    for (int node = 1, k = bits - 1; k >= 0; k--) for (int end = node * 2; node < end; node++) left[node] = 1 << k;
    total = 1 << bits;
    for (int i = 0; i < chance.length; i++) chance[i] = i % KINDS == 0 ? 8192 : 16384 + 2048 * (i % KINDS);
    Arrays.fill(weights, 26000);
  }

  // What orders 1 and 2 expect after the last two ids.
  void expect() {
    at1 = (before1 + 2) * 0x9E3779B1 >>> 32 - SLOTS1;
    at2 = ((before1 + 2) * 0x2C1B3C6D + (before2 + 2) * 0x297A2D39) * 0x9E3779B1 >>> 32 - SLOTS2;
    int a = first1[at1], b = second1[at1], c = first2[at2];
    guess1 = (c != 0 ? c : a) - 1;
    guess2 = (c != 0 && a != c ? a : b) - 1;
  }

  // The chance (of 65536) that guess k, the id x, is right.
  int predict(int k, int x) {
    int from = k * 3 * KINDS;
    c2 = from + (first2[at2] == x + 1 ? 1 + sure2[at2] : 0);
    c1 = from + KINDS + (first1[at1] == x + 1 ? 1 + sure1[at1] : second1[at1] == x + 1 ? 17 : 0);
    c0 = from + 2 * KINDS + Math.min(17, 32 - Integer.numberOfLeadingZeros(own[x]));
    s0 = STRETCH[chance[c0] >> 4];
    s1 = STRETCH[chance[c1] >> 4];
    s2 = STRETCH[chance[c2] >> 4];
    set = k * 3;
    int x0 = (weights[set] * s0 >> 16) + (weights[set + 1] * s1 >> 16) + (weights[set + 2] * s2 >> 16);
    mixed = SQUASH[Math.max(0, Math.min(4095, x0 + 2048))];
    return mixed;
  }

  void learn(int bit) {
    int error = (bit << 12) - (mixed >> 4);
    weights[set] = Math.max(0, Math.min(160000, weights[set] + (s0 * error >> 12)));
    weights[set + 1] = Math.max(0, Math.min(160000, weights[set + 1] + (s1 * error >> 12)));
    weights[set + 2] = Math.max(0, Math.min(160000, weights[set + 2] + (s2 * error >> 12)));
    int goal = bit * 65535;
    chance[c0] += goal - chance[c0] >> 6;
    chance[c1] += goal - chance[c1] >> 6;
    chance[c2] += goal - chance[c2] >> 6;
  }

  void seen(int id) {
    int x = id + 1;
    if (first2[at2] == x) {
      if (sure2[at2] < 15) sure2[at2]++;
    } else if (sure2[at2] > 1) sure2[at2] >>= 1;
    else { first2[at2] = x; sure2[at2] = 1; }
    if (first1[at1] == x) {
      if (sure1[at1] < 15) sure1[at1]++;
    } else if (sure1[at1] > 1) {
      sure1[at1] >>= 1;
      second1[at1] = x;
    } else { second1[at1] = first1[at1]; first1[at1] = x; sure1[at1] = 1; }
    before2 = before1;
    before1 = id;
  }

  void put(int b) {
    if (size == out.length) out = Arrays.copyOf(out, size * 2);
    out[size++] = (byte) b;
  }

  void shrink() {
    if (low >= TOP) {
      low -= TOP;
      int i = size - 1;
      while (++out[i] == 0) i--;
    }
    while (range < LEAST) {
      put((int) (low >>> 48));
      low = low << 8 & TOP - 1;
      range <<= 8;
    }
  }

  void encodeBit(int bit, int p) {
    long part = (range >>> 16) * p;
    if (bit == 1) range = part; else { low += part; range -= part; }
    shrink();
  }

  void encodeId(int id) {
    int node = 1, sum = 0;
    for (int k = bits - 1; k >= 0; k--) {
      if ((id >>> k & 1) == 0) { left[node] += STEP; node *= 2; }
      else { sum += left[node]; node = node * 2 + 1; }
    }
    long unit = range / total;
    low += unit * sum;
    range = unit * own[id];
    own[id] += STEP;
    total += STEP;
    shrink();
  }

  int read() { return next < in.length ? in[next++] & 255 : 0; }

  void fill() {
    while (range < LEAST) {
      code = code << 8 | read();
      range <<= 8;
    }
  }

  int decodeBit(int p) {
    long part = (range >>> 16) * p;
    int bit = code < part ? 1 : 0;
    if (bit == 1) range = part; else { code -= part; range -= part; }
    fill();
    return bit;
  }

  int decodeId() {
    long unit = range / total;
    int goal = (int) Math.min(total - 1, code / unit), node = 1, sum = 0;
    for (int k = bits - 1; k >= 0; k--) {
      if (goal - sum < left[node]) { left[node] += STEP; node *= 2; }
      else { sum += left[node]; node = node * 2 + 1; }
    }
    int id = node - (1 << bits);
    code -= unit * sum;
    range = unit * own[id];
    own[id] += STEP;
    total += STEP;
    fill();
    return id;
  }

  static int get(byte[] raw, int at, int width) {
    int x = (raw[at] & 255) | (raw[at + 1] & 255) << 8;
    return width == 2 ? x : x | (raw[at + 2] & 255) << 16 | (raw[at + 3] & 255) << 24;
  }

  static void putInt(byte[] to, int at, int x) {
    to[at] = (byte) (x >>> 24); to[at + 1] = (byte) (x >>> 16); to[at + 2] = (byte) (x >>> 8); to[at + 3] = (byte) x;
  }

  static int getInt(byte[] from, int at) {
    return (from[at] & 255) << 24 | (from[at + 1] & 255) << 16 | (from[at + 2] & 255) << 8 | (from[at + 3] & 255);
  }

  public static byte[] encode(byte[] raw) {
    int width = raw[0], bits = raw[1], n = (raw.length - 2) / width;
    MixCoder c = new MixCoder(bits);
    c.out = new byte[Math.max(64, raw.length)];
    c.out[0] = raw[0];
    c.out[1] = raw[1];
    CRC32 sum = new CRC32();
    sum.update(raw, 2, raw.length - 2);
    putInt(c.out, 2, n);
    putInt(c.out, 6, (int) sum.getValue());
    c.size = 10;
    for (int i = 0; i < n; i++) {
      int id = get(raw, 2 + i * width, width), hit = 0;
      if (id < 0 || id >>> bits != 0) throw new IllegalArgumentException("an id is out of range: " + id);
      c.expect();
      if (c.guess1 >= 0) {
        int p = c.predict(0, c.guess1);
        hit = c.guess1 == id ? 1 : 0;
        c.encodeBit(hit, p);
        c.learn(hit);
      }
      if (hit == 0 && c.guess2 >= 0) {
        int p = c.predict(1, c.guess2);
        hit = c.guess2 == id ? 1 : 0;
        c.encodeBit(hit, p);
        c.learn(hit);
      }
      if (hit == 0) c.encodeId(id);
      c.seen(id);
    }
    for (int i = 6; i >= 0; i--) c.put((int) (c.low >>> 8 * i));
    return Arrays.copyOf(c.out, c.size);
  }

  public static byte[] decode(byte[] coded) {
    int width = coded[0], bits = coded[1], n = getInt(coded, 2);
    MixCoder c = new MixCoder(bits);
    c.in = coded;
    c.next = 10;
    for (int i = 0; i < 7; i++) c.code = c.code << 8 | c.read();
    byte[] raw = new byte[n * width];
    for (int i = 0; i < n; i++) {
      int id = -1;
      c.expect();
      if (c.guess1 >= 0) {
        int hit = c.decodeBit(c.predict(0, c.guess1));
        c.learn(hit);
        if (hit == 1) id = c.guess1;
      }
      if (id < 0 && c.guess2 >= 0) {
        int hit = c.decodeBit(c.predict(1, c.guess2));
        c.learn(hit);
        if (hit == 1) id = c.guess2;
      }
      if (id < 0) id = c.decodeId();
      for (int b = 0; b < width; b++) raw[i * width + b] = (byte) (id >>> 8 * b);
      c.seen(id);
    }
    CRC32 sum = new CRC32();
    sum.update(raw, 0, raw.length);
    if ((int) sum.getValue() != getInt(coded, 6)) throw new IllegalStateException("a block differs from its checksum");
    return raw;
  }
}
"""

#: The function classes; raw types, as the compiler makes no bridge methods.
FUNCTION = """
package orderlens;

public class {name} implements org.apache.spark.sql.api.java.UDF1 {{
  public Object call(Object x) {{
    return x == null ? null : MixCoder.{method}((byte[]) x);
  }}
}}
"""

ENCODE, DECODE = "orderlens_encode_ids", "orderlens_decode_ids"


def register(spark: SparkSession) -> None:
    """Makes the SQL functions ``ENCODE`` and ``DECODE`` (binary to binary) known to the session."""
    jvm = spark._jvm
    if not getattr(spark.sparkContext, "_orderlens_coder", None):
        compiler = jvm.org.codehaus.janino.SimpleCompiler
        folder = tempfile.mkdtemp(prefix="orderlens-jar-")
        jar = os.path.join(folder, "orderlens-coder.jar")
        with zipfile.ZipFile(jar, "w") as z:
            loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            for source in (JAVA, *(JAVA.rstrip() + FUNCTION.format(name=n, method=m).replace("package orderlens;", "") for n, m in (("EncodeIds", "encode"), ("DecodeIds", "decode")))):
                one = compiler()
                one.setParentClassLoader(loader)
                one.cook(source)
                for name, code in one.getBytecodes().items():
                    path = name.replace(".", "/") + ".class"
                    if path not in z.namelist():
                        z.writestr(path, bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        spark.sparkContext._orderlens_coder = jar
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    nothing = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)
    no_types = spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)
    binary = spark._jsparkSession.parseDataType(T.BinaryType().json())
    for name, owner in ((ENCODE, "EncodeIds"), (DECODE, "DecodeIds")):
        function = loader.loadClass(f"orderlens.{owner}").getDeclaredConstructor(no_types).newInstance(nothing)
        spark._jsparkSession.udf().register(name, function, binary)
