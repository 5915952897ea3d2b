"""Names that no graph edge should point to: types and functions of the languages themselves, and frequent methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Called names that are too frequent to resolve.
COMMON_METHODS = frozenset(
    """
    add_edge add_node all any append as_mut_slice as_ref as_slice as_str buf build bytes capacity cb chain chars child children clear clone clone_from cmp
    collect contains count create ctx dbg debug dedup default deref display drain drop edge ends_with entries enumerate eq err expect extend filter find
    finish flat_map flush fmt fold for_each format from from_str get get_mut gg ggml gguf init insert into into_iter is_empty is_err is_none is_ok is_some
    iter iter_mut join keys last len lines lock make map max min ne new node nth ok parent partition pop position print println product ptr push recv
    reduce remove replace retain reverse root send setup skip sort sort_by spawn split starts_with sum take text tn to_lowercase to_string to_uppercase
    traverse trim trim_end trim_start unwrap unwrap_or unwrap_or_default unwrap_or_else values visit walk with_capacity write zip
    """.split()
)

_NAMES = {
    "c": """
        _Bool bool char double FILE float int int16_t int32_t int64_t int8_t intptr_t long NULL ptrdiff_t short signed size_t uint16_t uint32_t uint64_t
        uint8_t uintptr_t unsigned va_list void
    """,
    "cpp": """
        any array atomic auto bool char deque double false float function int int16_t int32_t int64_t int8_t intptr_t list long map mutex nullptr nullptr_t
        optional pair ptrdiff_t queue set shared_ptr short signed size_t stack std string this thread true tuple uint16_t uint32_t uint64_t uint8_t uintptr_t
        unique_ptr unsigned variant vector void weak_ptr
    """,
    "csharp": """
        Action Array base bool Boolean Byte byte CancellationToken Char char DateTime Decimal decimal Dictionary Double double dynamic Exception false float
        Func Guid HashSet IEnumerable int Int32 Int64 IntPtr List long nint nuint null Nullable Object object sbyte short Single String string Task this
        TimeSpan true Type uint UIntPtr ulong ushort var void
    """,
    "go": """
        any bool byte comparable complex128 complex64 error false float32 float64 int int16 int32 int64 int8 iota nil rune string true uint uint16 uint32
        uint64 uint8 uintptr
    """,
    "haskell": """
        Applicative Bool Bounded Char Double Either Enum Eq False Float Floating Foldable Fractional Functor Int Integer Integral IO Just Left Maybe Monad
        Monoid Nothing Num Ord Ordering Read Real RealFloat RealFrac Right Semigroup Show String Traversable True
    """,
    "java": """
        Boolean boolean Byte byte byte[] char char[] Character Class Double double double[] false Float float float[] int int[] Integer Long long long[] null
        Object Short short String String[] super System this true void
    """,
    "lua": """
        _G _VERSION assert boolean debug error false function io ipairs math next nil number os pack pairs pcall print rawget rawset require select self
        string table thread tonumber tostring true type unpack userdata xpcall
    """,
    "python": """
        all any BaseException bool bytearray bytes callable classmethod cls dict dir Ellipsis enumerate Exception False filter float hash help id input int
        isinstance issubclass len list map memoryview None object open print property range reversed self set sorted staticmethod str super True tuple type
        TypeError ValueError zip
    """,
    "ruby": """
        Array BasicObject Class Exception extend false Float Hash include Integer Lambda Module nil Object p pp print Proc puts Range Regexp require
        require_relative RuntimeError self StandardError String Symbol true
    """,
    "rust": """
        Arc AsMut AsRef BinaryHeap bool Box BTreeMap BTreeSet Cell char Clone Copy Cow Debug Default Deref DerefMut Display Drop Err Error f32 f64 Fn FnMut
        FnOnce Formatter From FromIterator HashMap HashSet i128 i16 i32 i64 i8 Into IntoIterator isize Iterator LinkedList None Ok Option Rc RefCell Result
        Self Send Sized Some str String Sync TryFrom TryInto u128 u16 u32 u64 u8 Unpin usize Vec VecDeque
    """,
    "scala": """
        Any AnyRef AnyVal Array Boolean Byte Char Double Either ExecutionContext Failure false Float Future Int IO java Left List Long Map None Nothing Null
        null Option Right scala Seq Set Short Some String Success super Task this true Try Unit Vector
    """,
    "swift": """
        Any any AnyObject Array Bool Character Dictionary Double Error false Float Int Int16 Int32 Int64 Int8 nil Optional Result Self self Set some String
        super true Type UInt UInt16 UInt32 UInt64 UInt8 Void
    """,
    "typescript": """
        any Array BigInt bigint Boolean boolean Capitalize ConstructorParameters Date Error Exclude Extract false Function InstanceType Lowercase Map never
        NonNullable null Number number Object object Omit OmitThisParameter Parameters Partial Pick Promise Readonly Record RegExp Required ReturnType Set
        String string super Symbol symbol this ThisParameterType ThisType true Uncapitalize undefined unknown Uppercase void WeakMap WeakSet
    """,
}
BUILTINS = {language: frozenset(names.split()) for language, names in _NAMES.items()}
BUILTINS["javascript"] = BUILTINS["typescript"]


def is_builtin(language: str, name: str) -> bool:
    """Whether the language itself has the name; an unknown language has none."""
    return name in BUILTINS.get(language, frozenset())


def is_common_method(name: Column) -> Column:
    """Whether a called name is on the stop list."""
    return name.isin(*sorted(COMMON_METHODS))


def builtin_table(spark: SparkSession) -> DataFrame:
    """(language, name) of all builtins."""
    return spark.createDataFrame([(k, n) for k, names in sorted(BUILTINS.items()) for n in sorted(names)], "language string, name string")


def without_builtins(references: DataFrame, language: str = "language", name: str = "type_name") -> DataFrame:
    """The references to types that are not of the language itself."""
    table = F.broadcast(builtin_table(references.sparkSession).toDF("_language", "_name"))  # some hundred rows
    return references.join(table, (F.col(language) == F.col("_language")) & (F.col(name) == F.col("_name")), "left_anti")
