"""Fixed schemas of trace events and coverage manifests; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

#: As written, in the writer's order.
WIRE_EVENT = _struct(
    testId=S, methodFullName=S, filePath=S, filePathResolution=S, line=I, callDepth=I, callId=L, ordinal=I, parentCallId=L,
    argsDigest=S, argsRendered=S, returnDigest=S, returnRendered=S, exceptionType=S, threadId=I, isHarness=B,
)

#: Wire name -> column.
EVENT_COLUMNS = {
    "testId": "test_id", "methodFullName": "method", "filePath": "file_path", "filePathResolution": "resolution", "line": "line", "callDepth": "call_depth",
    "callId": "call_id", "ordinal": "ordinal", "parentCallId": "parent_call_id", "argsDigest": "args_digest", "argsRendered": "args_rendered",
    "returnDigest": "return_digest", "returnRendered": "return_rendered", "exceptionType": "exception_type", "threadId": "thread_id", "isHarness": "is_harness",
}

EVENT = _struct(run=S, process=S, line_number=I, **{c: WIRE_EVENT[w].dataType for w, c in EVENT_COLUMNS.items()}, relative_path=S)

#: One wide record for every kind of manifest line.
WIRE_MANIFEST = _struct(
    kind=S, schema=S, language=S,
    assembly=S, discovery=S, scanned=B, instrumented=B, patchedMembers=I, discoveredMembers=I, skippedMembers=I, patchFailedMembers=I, membersWithExactSource=I,
    exactSourcePercent=I, queuedAtMs=L, patchedAtMs=L, tracedCalls=L, sourceRule=S, sourceUnavailable=B, sourcePartial=B, isTestAssembly=B, testFrameworkReference=S, detail=S,
    status=S, method=S, skipReason=S, returnKind=S, isTestRoot=B, sourceResolution=S,
    valuesDigested=L, depthLimited=L, blocklisted=L, errored=L, renderedTruncated=L, unreadableFields=L, ambiguousMapEntries=L,
    typeName=S, count=L, enqueued=L, written=L, dropped=L, capacity=I,
)

# Fixed values of the trace contract.
LANGUAGES = ("dotnet", "java", "node", "go")
DISCOVERIES = ("BuildTimeWeave", "JavaAgentTransform", "NodeAstTransform", "GoAstRewrite")
STATUSES = ("Patched", "Skipped", "PatchFailed", "EnumerationFailed")
SKIP_REASONS = ("Unobservable", "CompilerGenerated", "ExcludedByScope", "UnsupportedShape", "DeclaredExternally")
MANIFEST_KINDS = ("run", "assembly", "member", "digest", "unruled", "writer")
RETIRED_FIELDS = ("latePatched", "prePatchCoverage")
MAX_RENDERED = 2000
